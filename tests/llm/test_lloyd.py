import hashlib
import math
import random
import struct

import pytest

from leafgate.llm import lloyd, queries
from leafgate.llm.oracles import ORACLES
from tests.compare import same
from tests.llm.conftest import rows

COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(vectors, k, rounds):
    ok = [(i, [math.floor(64 * f32(x)) for x in v]) for i, v in vectors if v is not None and len(v) == lloyd.DIM and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in ok if i is not None)[:k]
    c = [v for _, v in first]
    far = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = [far(v)[1] for _, v in ok]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(ok, of) if o == j]
            c[j] = [sum(col) // len(own) for col in zip(*own)] if own else c[j]
    if not c:
        return []
    at = [(i, *far(v)) for i, v in ok]
    per = [sum(d for _, d, j in at if j == x) for x in range(len(c))]
    out = [(i, j, d, per[j], sum(per), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in at]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in vectors], "vec_id long, embedding array<float>, cluster int, n double")


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    one = [0.5] * 64
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(64)]) for i in range(60)] + [(2**60 + 1, one), (2**60 + 1, one), (None, one), (None, [-1.0] * 64)] * (seed + 1)
    vectors += [(70, [1.0] * 63), (71, [1.0] * 65), (72, None), (73, [float("nan")] + one[1:]), (74, [float("inf")] + one[1:]), (75, [None] + one[1:]), (76, [])]
    rng.shuffle(vectors)
    got = rows(lloyd.clustered(frame(spark, vectors).repartition(5), 4, 3), *COLUMNS)
    assert got == brute(vectors, 4, 3)
    assert got == rows(lloyd.clustered(frame(spark, vectors).coalesce(1), 4, 3), *COLUMNS)


def test_ties_few_vectors_and_empty_tables(spark):
    same_vector = [(i, [1.0] * 64) for i in range(5)]  # all centroids equal: cluster 0, the others keep theirs
    got = rows(lloyd.clustered(frame(spark, same_vector)), *COLUMNS)
    assert got == brute(same_vector, 16, 3) and {r[1] for r in got} == {0}
    for none in ([], [(None, [1.0] * 64)], [(1, [1.0])]):
        assert lloyd.clustered(frame(spark, none)).collect() == []
    with pytest.raises(Exception, match="too large"):
        lloyd.clustered(frame(spark, [(1, [1e9] * 64)])).collect()


def test_query_equals_sql(spark, sf):
    assert same(spark, sf, queries.op13_centroid_clusters, ORACLES["op13_centroid_clusters"]) > 0
