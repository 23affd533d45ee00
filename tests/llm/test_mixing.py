from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafgate.llm import mixing, queries
from leafgate.llm.mixing import mixed, period
from leafgate.llm.oracles import ORACLES
from tests.compare import same
from tests.llm.conftest import rows


@pytest.mark.parametrize("shares", [[1], [1, 1, 1], [5, 3, 1], [97, 1, 1, 1], [13, 11, 7, 5, 3, 2]])
def test_less_than_one_block_of_deviation(spark, shares):
    frame = spark.createDataFrame([(f"s{i:02}", 1000, q) for i, q in enumerate(shares)], "src string, n long, share long")
    order = [r["src"] for r in period(frame).orderBy("slot").collect()]
    total, had = sum(shares), Counter()
    assert len(order) == total
    for t, s in enumerate(order, 1):
        had[s] += 1
        for i, q in enumerate(shares):
            assert abs(had[f"s{i:02}"] - t * q / total) < 1


def test_positions_and_edges(make, spark):
    docs = [(i, "t", "en", "hot") for i in range(100)] + [(i, "t", "en", "b") for i in range(200, 217)] + [(300, None, None, None), (300, None, None, None), (None, "x", "en", "b")]
    frame = make(*docs)
    out = mixed(frame, block_size=4, bucket_rows=3)
    assert set(out.columns) == {*frame.columns, "block", "slot", "position"}
    assert [r[0] for r in rows(out, "position")] == list(range(len(docs)))
    by = out.orderBy("position").select("slot", "source", "block").collect()
    assert [r["slot"] for r in by] == sorted(r["slot"] for r in by)
    assert out.groupBy("slot").agg(F.count_distinct(F.coalesce("source", F.lit(""))).alias("n")).where("n > 1").count() == 0
    assert rows(mixed(frame, block_size=4), "position", "doc_id") == rows(mixed(frame.repartition(7), block_size=4), "position", "doc_id")
    assert mixed(frame.limit(0)).count() == 0


def test_given_weights(make):
    docs = [(i, "t", "en", "ab"[i % 2]) for i in range(400)]
    first = mixed(make(*docs), {"a": 3, "b": 1}, block_size=1).where("position < 40").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in first} == {"a": 30, "b": 10}


def test_query_equals_sql(spark, sf):
    assert same(spark, sf, queries.op10_mix_sources, ORACLES["op10_mix_sources"]) == 200


def test_many_sources_keep_their_weights(spark):
    """Three hundred sources, one of which holds a third of all rows."""
    counts = spark.createDataFrame([("hot", 150_000)] + [(f"s{i}", 1000) for i in range(299)], "src string, n long")
    got = {r["src"]: r["share"] for r in mixing.shares(counts).collect()}
    roots = {"hot": 150_000**0.5} | {f"s{i}": 1000**0.5 for i in range(299)}
    for src, share in got.items():
        assert abs(share / sum(got.values()) - roots[src] / sum(roots.values())) < 0.005
    assert got["hot"] > 10 * got["s0"]
    slots = mixing.period(mixing.shares(counts.where("n > 1000 or src < 's14'"))).select("src", "slot", "total").collect()
    assert sorted(r["slot"] for r in slots) == list(range(slots[0]["total"]))


def test_positions_of_many_sources_equal_those_of_few(make, monkeypatch):
    docs = [(i, "t", "en", f"s{i * i % 37}") for i in range(900)] + [(i, "t", "en", "hot") for i in range(900, 1400)] + [(None, None, None, None), (1, "t", "en", "s1"), (1, "t", "en", "s1")]
    few = rows(mixed(make(*docs), block_size=3, bucket_rows=50), "position", "slot", "block", "doc_id")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "SPAN", 16)
    many = mixed(make(*docs), block_size=3, bucket_rows=50)
    assert rows(many, "position", "slot", "block", "doc_id") == few
    assert [r["position"] for r in many.select("position").orderBy("position").collect()] == list(range(len(docs)))
    assert mixed(make(*docs).limit(0)).count() == 0


def test_a_thousand_sources(spark):
    counts = spark.range(1000).selectExpr("concat('s', id) as src", "if(id = 0, 500000, 10 + id % 990) as n")
    slots = period(mixing.shares(counts), kept=False).collect()
    total, had = slots[0]["total"], Counter()
    share = {r["src"]: r["share"] for r in mixing.shares(counts).collect()}
    for r in sorted(slots, key=lambda r: r["slot"]):
        assert r["k"] == had[r["src"]] and r["k"] * total // share[r["src"]] <= r["slot"] < -(-(r["k"] + 1) * total // share[r["src"]])
        had[r["src"]] += 1
    assert had == share and len(slots) == total
