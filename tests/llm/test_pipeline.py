import corpus_pipeline
from leafgate.llm.decontaminate import contamination
from leafgate.llm.neardup import classes
from leafgate.llm.pii import base_spans
from leafgate.llm.tables import table, written
from tests.llm.conftest import rows


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = {r[0] for r in rows(docs, "doc_id")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), "test")
        after = {r[0] for r in rows(out, "doc_id")}
        assert after <= before and out.count() == len(after)
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        if name == "near_dedup":
            assert after == {r[0] for r in rows(classes(docs).where("kept"), "doc_id")}
        if name == "decontamination":
            assert after == {r[0] for r in rows(contamination(docs, table(spark, sf, "benchmark")).where("not contaminated"), "doc_id")}
        if name == "personal_data":
            assert after == before
            was, now = dict(rows(docs, "doc_id", "text")), dict(rows(out, "doc_id", "text"))
            assert all((was[i] == now[i]) == (not base_spans(was[i])) or not base_spans(was[i]) for i in after)
            assert not any(base_spans(t) for t in now.values())
        if name == "mixing":
            assert after == before and [r[0] for r in rows(out, "position")] == list(range(len(after)))
        assert out.columns[: len(columns)] == columns
        docs, before = out, after


def test_null_and_empty_rows_pass(make):
    docs = make((1, None), (2, ""), (None, "some words here"))
    for name, stage in corpus_pipeline.STAGES:
        if name in ("near_dedup", "personal_data", "mixing"):
            assert stage(docs.sparkSession, docs, "").count() == 3
