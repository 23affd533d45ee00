"""Each stage on null, empty, long, equal and clashing rows, and on an empty table."""

import random

import pytest

import corpus_pipeline
from leafgate.llm.tables import written

STAGES = dict(corpus_pipeline.STAGES)
#: Columns named as the operators name their own, beside those of documents.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _c0 long, key long, twin long, id long, leader long, spans string, hash string, data binary, part int, `__key` int, doc long, bucket int, kind string, h string, `_src` string, `a.b` string"
WORDS = "the of and to in that is was for on with as they at be this have from or one had by word but not what all were we when your can said there".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with a benchmark of two items, one of them null."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "only these seven words are the item"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    said = [(i, text(60), "en", "ab"[i % 2]) for i in range(60)]
    said += [(100, None, "en", "a"), (101, "", None, None), (102, " \n\t", "en", None), (103, "12 + 3", None, "a"), (None, text(50), None, "b"), (None, None, None, None)]
    said += [(200, said[3][1], "en", "a"), (201, text(40), "en", "c"), (201, "same row of words that stands here twice or more", "en", "c"), (202, "same row of words that stands here twice or more", "en", "c")]
    said += [(203, "mail me@x.org or +1 (555) 123-4567 now " + text(30), "en", "c"), (204, "we know only these seven words are the item " + text(30), "en", "c"), (205, text(60_000), "en", "c")]
    said += [said[5], said[5]]
    own = [(i, t, lang, s, 0, 1, 2, 3, 4, 5, "s", "h", bytearray(b"d"), 6, 7, 8, 9, "k", "h", "s", "d") for i, t, lang, s in said]
    return written(spark.createDataFrame(own, CLASHING), "edges")


def counted(df):
    out = {}
    for r in df.select("doc_id", "text").collect():
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


@pytest.mark.parametrize("name", STAGES)
def test_columns_pass_and_empty_tables_stay_empty(spark, sf, docs, name):
    out = written(STAGES[name](spark, docs, sf), "edges-out")
    assert out.columns[: len(docs.columns)] == docs.columns
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    assert out.select(*(f"`{c}`" for c in rest)).distinct().count() == 1  # each column is the caller's still
    none = STAGES[name](spark, docs.limit(0), sf)
    assert none.columns == out.columns and none.count() == 0


def test_language_id_drops_what_has_no_letters(spark, sf, docs):
    was, now = counted(docs), counted(STAGES["language_id"](spark, docs, sf))
    assert now == {k: n for k, n in was.items() if k[1] and any(map(str.isalpha, k[1]))}


def test_near_dedup_keeps_the_first_of_equal_texts_and_all_without_words(spark, sf, docs):
    was, now = counted(docs), counted(STAGES["near_dedup"](spark, docs, sf))
    gone = {k for k in was if k not in now}
    assert {i for i, _ in gone} == {200, 202} and all(now[k] == was[k] for k in now)


def test_decontamination_drops_the_item(spark, sf, docs):
    was, now = counted(docs), counted(STAGES["decontamination"](spark, docs, sf))
    assert {k[0] for k in was if k not in now} == {204} and all(now[k] == was[k] for k in now)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/none/benchmark.parquet")
    assert counted(STAGES["decontamination"](spark, docs, f"{sf}/none")) == was


def test_personal_data_changes_one_text(spark, sf, docs):
    was, now = counted(docs), counted(STAGES["personal_data"](spark, docs, sf))
    changed = {k for k in was if k not in now}
    assert {k[0] for k in changed} == {203} and sum(was.values()) == sum(now.values())
    (text,) = (t for i, t in now if i == 203)
    assert text.startswith("mail [EMAIL] or [PHONE] now ")


def test_mixing_places_every_row(spark, sf, docs):
    out = STAGES["mixing"](spark, docs, sf)
    assert counted(out) == counted(docs)
    assert sorted(r["position"] for r in out.select("position").collect()) == list(range(docs.count()))
