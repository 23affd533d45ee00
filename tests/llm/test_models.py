import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafgate.llm import fertility, langid, maxent, pii, queries
from leafgate.llm.oracles import ORACLES
from leafgate.llm.textarrays import NON_SPACE, Words, texts_of
from tests.compare import same
from tests.llm.conftest import rows

EN = "the house of the rising sun is in the town and they say that it has been the ruin of many".split()
DE = "der die das und nicht ein haus über straße schön für möchte auch werden zwischen größe jedoch".split()


def sentences(words, n, size=40):
    return [" ".join(words[(i * 7 + j * 3 + i * j) % len(words)] for j in range(size)) for i in range(n)]


@pytest.mark.parametrize("name", ["op4_decontaminate", "op6_substring_dedup"])
def test_query_equals_sql(spark, sf, name):
    assert same(spark, sf, queries.QUERIES[name], ORACLES[name]) == 200


def test_language_id(make, spark):
    docs = [(i, t, "en") for i, t in enumerate(sentences(EN, 60))] + [(100 + i, t, "de") for i, t in enumerate(sentences(DE, 60))]
    docs += [(900, None, "en"), (901, "12 + 3 — …", "en"), (902, "", None), (903, "the town", None), (903, "the town", None), (None, "schön für", None), (904, "über " * 20000, None)]
    frame = make(*docs)
    model = langid.train(frame.where(~langid.held_out(frame.doc_id)))
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in docs[:120])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in docs if i is not None)
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0, True) for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and got[904]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in docs} - {900, 901, 902}
    none = langid.train(frame.limit(0))
    assert {r["lang_pred"] for r in langid.identify(frame, none).collect()} == {"und"}
    assert langid.identify(frame.limit(0), model).count() == 0


def test_kneser_ney_sums_to_one():
    model = langid.Model({"x": {"abab": 5, "abc": 2, "ca": 1}})
    for before in ("", "a", "ab", "zz"):
        total = 0.0
        for c in [*"abcz", ""]:
            grams = langid.Grams(before + c + "\n")
            at = grams.at[len(before) : len(before) + 1]
            total += 2.0 ** -float(model.bits(grams, at)[0, 0])
        assert abs(total - 1) < 1e-5  # four characters, one of them unknown, and the end


def test_quality_counts(make):
    text = "# a b c a b c\nsame line\n \nsame line\n" + "x|y ü " * 3
    docs = [(1, text), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}" for i in range(60))), (None, "a " * 60, None)]
    got = fertility.quality(make(*docs), [queries.vocabulary("piece_bpe_32k.model")]).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    w = text.split()
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
    assert (by[1]["n_words"], by[1]["word_chars"], by[1]["n_symbols"], by[1]["n_dup_lines"], by[1]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), 1, len(hit))
    assert by[2]["n_words"] == by[3]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
    assert not by[4]["base_failed"] and by[4]["kept"] and by[None]["base_failed"]
    assert fertility.quality(make((1, "a")).limit(0), [queries.vocabulary("piece_bpe_32k.model")]).count() == 0


def test_quality_bands_reject_what_the_base_rules_keep(spark):
    at = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in spark.read.parquet(f"{at}/labels.parquet").where("quality = 1").collect()}
    past = [r for r in queries.QUERIES["op5_quality"](spark, at).collect() if not r["base_failed"]]
    junk = [r["kept"] for r in past if r["n_symbols"] > r["n_words"]]
    clean = [r["kept"] for r in past if r["doc_id"] in good and r["n_symbols"] <= r["n_words"]]
    assert junk and junk.count(False) >= len(junk) / 4
    assert clean and clean.count(False) <= len(clean) / 50


def test_tokens_are_those_of_whole_texts():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    texts = ["the quick brown fox the", "größe  über\nstraße", "", "世 x"]
    size, tokens = fertility.Splitter(path)(Words(texts_of(pa.array(texts)), NON_SPACE))
    want = [t for x in texts for t in sentencepiece.SentencePieceProcessor(model_file=path).encode(" ".join(x.split()))]
    assert tokens.tolist() == want and size.sum() == len(want)


def test_personal_data_forms():
    luhn = "4539 1488 0343 6467"
    text = f"a.b@c.de, 1.2.3.4 999.1.1.1; {luhn}; 4539148803436468; +1 (555) 010-9999 +12 x@y"
    said = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert said == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", luhn), ("phone", "+1 (555) 010-9999")]
    assert pii.base_spans("") == [] and not pii.valid("ip", "1.2.3." + "9" * 5000)


def test_bootstrapping_finds_what_has_no_form(make):
    docs = [(i, f"text number call me under +1 (555) 0{i:02}-1234 today é") for i in range(10)]
    docs += [(50, "text ü call me under 555-0188 today"), (51, "about 2024-11 events"), (52, None), (53, "call me under 555-0188 today"), (53, "call me under 555-0188 today"), (None, "x 1.2.3.4")]
    frame = make(*docs)
    got = {r["doc_id"]: r for r in pii.personal_data(frame).collect()}
    assert got[0]["n_phone"] == 1 and got[50]["n_phone"] == 0
    at = docs[10][1].index("555")
    assert got[50]["spans"] == f"phone:{at}:{at + 8}" and got[51]["spans"] == "" and got[52]["spans"] == "" and got[None]["n_ip"] == 1
    assert pii.personal_data(frame).count() == len(docs)
    red = dict(rows(pii.redacted(frame), "doc_id", "text"))
    assert pii.redacted(frame).columns == frame.columns
    assert red[50] == "text ü call me under [PHONE] today" and red[51] == docs[11][1] and red[52] is None and red[None] == "x [IP]"
    assert pii.personal_data(frame.limit(0)).count() == 0 and pii.redacted(frame.limit(0)).count() == 0


def test_lm_scores(make):
    docs = [(i, t.upper() if i % 3 else t) for i, t in enumerate(sentences(EN, 50))] + [(100 + i, t) for i, t in enumerate(sentences(DE, 50))]
    docs += [(500, None), (501, " "), (502, "never seen"), (502, "never seen"), (None, "the sun")]
    got = maxent.scores(make(*docs)).collect()
    assert len(got) == len(docs)
    counts, tokens = Counter(), {}
    for i, t in docs:
        tokens[i] = (t or "").lower().split() + [None]
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for i, ws in tokens.items()}
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - base[r["doc_id"]]) < 1e-9 and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["doc_id"] < 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent.scores(make((1, "a")).limit(0)).count() == 0


def test_lm_probabilities_sum_to_one(make):
    docs = make(*[(i, t) for i, t in enumerate(sentences(EN[:6] + DE[:4], 40))])
    vocab = maxent.vocabulary(docs.select("text"))
    model = maxent.fit(docs.select("text"), vocab)
    lex = model.lexicon
    assert np.allclose((10.0 ** model.by_context.astype(float)).sum(1), 1, atol=1e-4)
    for c in range(maxent.CLASSES):
        own = model.symbol_class == c
        if own.any():
            assert np.allclose(np.exp(model.by_class[:, own].astype(float)).sum(1), 1, atol=1e-4)
    rare = lex.symbol < 0
    assert not rare.any() and lex.ending_words.sum() == 0  # so few words are all symbols
