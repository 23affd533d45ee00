"""Reading the tables, and intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leafgate.plans.scratch import fresh
from leafgate.plans.ship import shipped

_made: list[str] = []


def sifted(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows that run leaves of docs, whatever the names of its columns: run knows text only. (Spark resolves names by their text here, dots too.)"""
    plain = docs.toDF(*(c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    at = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    _made.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def made() -> list[str]:
    """Paths of the tables that this process has written, in order."""
    return list(_made)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    for p in paths:
        path = hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
