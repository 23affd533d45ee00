"""Fertility bands against a brute-force version; a rejection by each measure; edge cases."""

import base64
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
import tiktoken

from leafgate.llm import fertility, queries
from tests.llm.conftest import rows

PATHS = [queries.vocabulary("piece_bpe_32k.model"), queries.vocabulary("byte_bpe_multi_50k.tiktoken")]
WORDS = "the people of this small town have always been very proud of their long history and they often talk about what their parents did when the river was high after many days of rain while others would rather speak of new plans for schools roads and parks that might bring visitors every summer".split()


def encoders():
    piece = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    with open(PATHS[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pair = tiktoken.Encoding("own", pat_str=fertility.CUT, mergeable_ranks=ranks, special_tokens={})
    back = {r: t for t, r in ranks.items()}
    part = lambda i: "�" in back[i].decode("utf-8", "replace") and back[i] != "�".encode()
    return [(piece.encode, piece.is_byte), (lambda w: pair.encode_ordinary(" " + w), part)]


def brute(docs, reach=fertility.REACH):
    """doc_id: kept."""
    found, base = {}, {}
    for i, text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
        base[i] = len(words) < 50 or 100 * len(again) > 50 * len(words)
        for v, (encode, is_byte) in enumerate(encoders_once):
            tokens = [t for w in words for t in encode(w)]
            n = max(1, len(tokens))
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
            size = 32_000 if v == 0 else 50_256
            found[i, v] = (sum(map(len, words)) / n, sum(map(is_byte, tokens)) / n, entropy / math.log2(min(max(len(tokens), 2), size)), len(tokens))
    out = {}
    for i, _, lang in docs:
        gone = False
        for m, least in enumerate(fertility.LEAST.values()):
            votes = []
            for v in range(2):
                usual = [round(found[j, v][m], 3) for j, _, x in docs if x == lang and not base[j]]
                if not usual:
                    votes.append(False)
                    continue
                low, mid, high = np.percentile(usual, [25, 50, 75])
                wide = math.sqrt(1 + fertility.SHORT / max(found[i, v][3], 1))
                x = found[i, v][m]
                votes.append(x < mid - wide * max(reach * (mid - low), least) or x > mid + wide * max(reach * (high - mid), least))
            gone |= all(votes)
        out[i] = not base[i] and not gone
    return out


encoders_once = encoders()


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, text(rng.randint(60, 200)), ("en", "xx")[i % 2]) for i in range(120)]
    docs += [
        (900, " ".join("".join(rng.choice("qzxkvjwfb") for _ in range(7)) for _ in range(150)), "en"),  # few characters a token
        (901, " ".join(chr(0x10330 + rng.randrange(25)) * 2 + rng.choice(WORDS) for _ in range(150)), "en"),  # bytes
        (902, " ".join(rng.choice(["river", "rain", "roads"]) for _ in range(20)) + " " + " ".join("town people of the park".split()[k % 5] for k in range(40)), "en"),
        (903, text(20), "en"), (904, None, "en"), (905, "", "xx"), (906, text(80), "alone"),
    ]
    return docs


def test_kept_equals_brute_force(make):
    docs = corpus()
    out = fertility.quality(make(*docs), PATHS)
    assert dict(rows(out, "doc_id", "kept")) == brute(docs)


def test_each_measure_rejects_by_itself(make):
    """With the other measures' bands wide open."""
    docs = corpus()
    calm = [i for i, *_ in docs if i < 900]
    rng = random.Random(8)
    poor = [f"{a} {b}" for a in ("river", "rain") for b in ("town", "park")]
    docs.append((910, " ".join(rng.choice(poor) for _ in range(300)), "en"))
    low = {"chars_per_token": 900, "fallback_share": 901, "entropy_ratio": 910}
    got = {r["doc_id"]: r for r in fertility.quality(make(*docs), PATHS).collect()}
    for measure, i in low.items():
        for c in (measure, f"{measure}_2"):
            usual = [got[k][c] for k in calm]
            assert not min(usual) <= got[i][c] <= max(usual), (c, i)
    assert not got[900]["kept"] and not got[901]["kept"] and all(got[k]["kept"] for k in calm)
    assert not got[900]["base_failed"] and not got[901]["base_failed"]


def test_long_texts_ties_and_repeated_rows(make):
    text = " ".join(WORDS) + " "
    docs = [(1, text * 2000, None), (2, "Abc " * 3 + "абв " * 3, None), (2, "Abc " * 3 + "абв " * 3, None), (None, "12 34", None)]
    out = fertility.quality(make(*docs), PATHS).collect()
    assert len(out) == 4 and {r["band"] for r in out} == {"script:latin"} | {r["band"] for r in out if r["doc_id"] is None}
    assert next(r for r in out if r["doc_id"] == 1)["n_words"] == 2000 * len(WORDS)
