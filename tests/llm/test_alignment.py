"""The alignment against spans of plain encodings; edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from leafgate.llm import alignment, queries
from tests.llm.conftest import rows

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "x", "x ", " x", "a  b\n\n c \t d", "é à  ça   b  c", "a▁b c", "▁", "<|endoftext|> </s> <s> <unk> <0x41>", "x\x00y \x85 z", "日本語 の 文 章　です 。", "안녕 하세요 여러분", "Привет мир 'll we've  it's",
       "🙂 🙂🙂 á b", "tail \n", "n1 22 333 4444.5", "x" * 3000, "\r\n a\r\n", " ́x y", "a  b   c"]


def brute(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, sha256."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = alignment._byte_of()
    out, links = [], Counter()
    for t in texts:
        groups, own = [], []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            spelt = ([bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
            if all(b"".join(s) == (" " + t).encode() for s in spelt):
                ends = []
                for s, i in zip(spelt, ids):
                    at, e = 0, {}
                    for x, k in zip(s, i):
                        at += len(x)
                        e[at] = k
                    ends.append(e)
                both = sorted(set(ends[0]) & set(ends[1]))
                for lo, hi in zip([0, *both], both):
                    groups.append("|".join(",".join(str(k) for at, k in e.items() if lo < at <= hi) for e in ends))
                own = [(ends[0][x], ends[1][x]) for x in both]
                links.update(own)
                out.append((len(ids[0]), len(ids[1]), groups, own))
                continue
        out.append((0, 0, [], []))
    best = defaultdict(int)
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(g), len(o), sum(links[p] == best[p[1]] for p in o), sum(links[p] for p in o), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, o in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def made(make, texts):
    docs = make(*enumerate(texts))
    return [r[1:] for r in rows(alignment.alignments(docs, A, B), "doc_id", *COLUMNS)]


def test_odd_texts_equal_spans_of_plain_encodings(make):
    texts = ODD + ["the cat and the dog", "the cat and the dog", "a cat"] + [" ".join(t for t in ODD if t)]
    assert made(make, texts) == brute(texts)


def test_random_texts(make, monkeypatch):
    rng = random.Random(11)
    bits = ["a", "the", " ", "  ", "\n", "é", " ", "ß", "日", "▁", "1", "'s", ".", "\t", " ", "🙂", "word", "Z", "\x1c", "안"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)  # joined by shuffle
    assert made(make, texts) == brute(texts)


def test_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    assert [r[1:] for r in rows(queries.op11_token_alignment(spark, sf), "doc_id", *COLUMNS)] == brute(texts)


def test_null_and_repeated_ids_and_empty_table(make):
    docs = make((None, "one two"), (None, "one two"), (3, "one two"), (3, "one"), (4, None))
    out = rows(alignment.alignments(docs, A, B), "doc_id", "n_links", "count_sum")
    assert [r[:2] for r in out] == [(3, 1), (3, 2), (4, 0), (None, 2), (None, 2)]
    assert out[1][2] == out[3][2] == out[4][2] == 4 + 3
    assert alignment.alignments(docs.limit(0), A, B).count() == 0


def test_groups_and_overlaps_are_given(make):
    out = alignment.aligned(make((1, "one  two")), A, B).first()
    assert out["n_groups"] == out["groups"].count(";") + 1
    a, b, ends = alignment.overlaps(alignment.np.array([1, 2, 3]), alignment.np.array([2, 1, 3]))
    assert list(zip(a.tolist(), b.tolist(), ends.tolist())) == [(0, 0, False), (1, 0, False), (1, 1, True), (2, 2, True)]


@pytest.mark.parametrize("kept", [0, 3])
def test_what_is_kept_changes_nothing(kept, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", kept)
    texts = alignment.Texts
    aligner = alignment.Aligner(A, B)
    import numpy as np

    for t in ("one two three one", "two four", "one a▁b", "two four five"):
        raw = t.encode()
        number, first = aligner(texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        (want,) = brute([t])
        assert aligner.sizes[number].sum(0)[:3].tolist() == list(want[:3])
        said = "".join(aligner.said[number])[:-1]
        assert (hashlib.sha256(said.encode()).hexdigest() if said else "") == want[6]
