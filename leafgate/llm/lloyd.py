"""Centroid clustering by plain Lloyd rounds in whole numbers.

A vector of `dim` components, none null or non-finite, becomes the integers floor(64 x), x as double. Centroids
start as the kept vectors with the smallest sha256 of `1:<vec_id>`. In each round the centroids, a table of k by `dim`
integers that does not grow with the input, are sent to all tasks; `mapInPandas` finds the squared differences to each
centroid in numpy and takes the first of the least; each task adds up integers per cluster, a `groupBy` merges the
partial sums, and the k new centroids (floor of sum by count) come back. All sums are whole numbers, so the
result does not depend on how rows are dealt to tasks. No round depends on tables of earlier rounds: a lost task reads the input again.

Defined results: other vectors (null, of another length, with a null or non-finite component) are left out; an empty table gives an
empty result; repeated rows are vectors of their own, and give each its own row; equal distances go to the smaller number; a vector with a null vec_id is
clustered, but starts no centroid; of rows with one vec_id that could start a centroid, the smaller vector comes first; with fewer than k such
vectors there are fewer centroids, and with none no rows; empty clusters keep their centroid; extra columns are left out. Components beyond +-2**24
(values beyond 262,144) are an error, because squared distances might not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
MOST = 1 << 24


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id, v (doubles): the vectors that are clustered."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & finite)


def integers(rows: pd.Series, scale: int = SCALE) -> np.ndarray:
    """A row of whole numbers for each vector."""
    x = np.floor(float(scale) * np.stack(rows.to_numpy()).astype(float))
    if (np.abs(x) > MOST).any():
        raise ValueError(f"components beyond {MOST // scale} are too large")
    return x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; of equal ones the first."""
    squares = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        squares[:, k] = np.einsum("ij,ij->i", d, d)
    cluster = squares.argmin(1)
    return cluster, squares[np.arange(len(x)), cluster]


def starts(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The first centroids: a top-k by hash, so each task sends k rows at most."""
    named = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.select("h", "v").orderBy("h", "v").limit(k).toPandas()
    return integers(first["v"], scale) if len(first) else np.zeros((0, 0), np.int64)


def _per_task(centroids: np.ndarray, scale: int, sums: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of a task's vectors, per cluster: how many, the sum of distances and (sums) of each component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, dim = centroids.shape
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if len(batch):
                x = integers(batch["v"], scale)
                cluster, distance = nearest(x, centroids)
                n += np.bincount(cluster, minlength=k)
                np.add.at(far, cluster, distance)
                if sums:
                    np.add.at(total, cluster, x)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "far": far[used], "total": list(total[used]) if sums else [[]] * len(used)})

    return run


def _merged(rows: DataFrame, centroids: np.ndarray, scale: int, sums: bool) -> list:
    """cluster, n, far and total: the partial sums of all tasks, merged. A row for each centroid at most."""
    parts = rows.select("v").mapInPandas(_per_task(centroids, scale, sums), "cluster int, n long, far long, total array<long>")
    each = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(centroids.shape[1])] if sums else []
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *each).collect()


def train(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE) -> np.ndarray:
    """The centroids after so many rounds. rows: of `kept`."""
    centroids = starts(rows, k, seed, scale)
    for _ in range(rounds if len(centroids) else 0):
        new = centroids.copy()
        for r in _merged(rows, centroids, scale, sums=True):
            new[r["cluster"]] = [r[f"t{j}"] // r["n"] for j in range(centroids.shape[1])]
        centroids = new
    return centroids


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(integers(batch["v"], scale), centroids)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    id_type = rows.schema["vec_id"].dataType
    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v")  # pandas would make doubles of numbers with nulls
    return named.mapInPandas(run, "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(id_type))


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    rows = kept(vectors, dim=dim)
    centroids = train(rows, k, rounds, seed)
    inertia, digest = {}, {}
    if len(centroids):
        inertia = {r["cluster"]: r["far"] for r in _merged(rows, centroids, SCALE, sums=False)}
        digest = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids.tolist())}
    else:  # no vector could start a centroid
        rows = rows.where(F.lit(False))
    of = rows.sparkSession.createDataFrame([(i, inertia[i], digest[i]) for i in inertia], "cluster int, cluster_inertia long, centroid_sha256 string")
    out = assigned(rows, centroids).join(F.broadcast(of), "cluster")  # a row for each centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")
