import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafgate.llm import queries, sharding
from leafgate.llm.oracles import ORACLES
from tests.compare import same
from tests.llm.conftest import rows


def best(sizes, k):
    """Smallest largest sum of k contiguous parts, by trying all cuts."""
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, n))) for cuts in itertools.combinations_with_replacement(range(n + 1), k - 1))


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_smallest(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50]) if seed % 2 else rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
    for k in (1, 2, 4):
        atoms = spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(sizes)], "atom string, bytes long")
        got = sharding.partition(atoms, k).orderBy("atom").collect()
        shards = [r["shard"] for r in got]
        assert shards == sorted(shards) and set(shards) <= set(range(k))
        sums = [sum(x for x, s in zip(sizes, shards) if s == j) for j in range(k)]
        assert max(sums) <= got[0]["capacity"] == best(sizes, k)


def test_cuts_are_even_beside_a_large_atom(spark):
    sizes = [10] * 50 + [500] + [10] * 250
    atoms = spark.createDataFrame([(f"{i:03}", x) for i, x in enumerate(sizes)], "atom string, bytes long")
    sums = [r["b"] for r in sharding.partition(atoms, 10).join(atoms, "atom").groupBy("shard").agg(F.sum("bytes").alias("b")).orderBy("shard").collect()]
    assert len(sums) == 10 and max(sums) == 500 and min(sums) >= 150


def test_edges(make, spark):
    long = "x" * 300_000
    docs = [(i, f"text {i}") for i in range(300)] + [(i, "same") for i in range(1000, 1100)] + [(None, None), (None, None), (5, ""), (6, long), (7, "é"), (7, "é"), (8, None)]
    frame = make(*docs)
    out = sharding.sharded(frame, shards=7, bucket_rows=5).cache()
    assert out.columns == [c for c in frame.columns if c not in sharding.RESULTS] + list(sharding.RESULTS)
    got = out.collect()
    assert len(got) == len(docs)
    where = {}
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert where.setdefault(r["text"] or "", r["shard"]) == r["shard"]
    for j in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sum(r["shard"] == j for r in got)))
    whole = rows(sharding.sharded(frame.repartition(5), shards=7), "doc_id", "shard", "slot")
    assert whole == rows(out, "doc_id", "shard", "slot")
    assert sharding.sharded(frame.limit(0)).count() == 0
    assert sharding.sharded(make((1, "a")), shards=40).collect()[0]["shard"] == 0


def test_written_shards(make, tmp_path, spark):
    out = sharding.sharded(make(*((i, f"t{i}") for i in range(40))).withColumnRenamed("key", "a.b"), shards=3)
    sharding.write_shards(out, str(tmp_path / "s"), rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows(back, "doc_id", "shard", "slot") == rows(out, "doc_id", "shard", "slot")
    assert {p.name for p in (tmp_path / "s").glob("shard=*")} == {f"shard={r['shard']}" for r in out.select("shard").distinct().collect()}


def test_query_equals_sql(spark, sf):
    assert same(spark, sf, queries.op12_sharding, ORACLES["op12_sharding"]) == 200
    assert same(spark, "/root/testdata/sf0.01", queries.op12_sharding, ORACLES["op12_sharding"]) == 1000
