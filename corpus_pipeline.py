"""The corpus pipeline: documents through five operators, each stage written and read again.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame with the columns of
documents (the last one adds the place in the mixture). Each works on all that the stage before it kept.

All stages take documents with further columns, whatever their names, and pass them on; repeated rows are rows like
others; null doc_ids, langs and sources are allowed; texts are read whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafgate.llm import decontaminate, langid, mixing, neardup, pii
from leafgate.llm.tables import made, removed, table, written
from leafgate.plans.ship import shipped


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and whose text is like it.

    Null, empty and letterless texts go, and so does noise. A tie goes to the language that sorts first, which changes nothing here: what
    counts is the limit of the language. Documents with a null lang are judged, but not learned from. Without any labelled document no language is known, and all go.
    Repeated rows are kept or go together.
    """
    shipped(spark)
    return langid.keep_identified(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id, so there are no ties.

    Null and empty texts and texts of white space are no copies of each other: all stay. Documents with a null doc_id stay. Rows of one doc_id are one document:
    all rows of the one that stays do.
    """
    shipped(spark)
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; so does everything if the benchmark is empty. Null and wordless items occur nowhere. Repeated rows stay or go together.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets.

    Null and empty texts stay as they are. Of overlapping spans the first, and of those that start together the first kind, is replaced. Repeated rows are
    replaced alike.
    """
    shipped(spark)
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with block, slot and position in the mixture.

    A null source is the source ''. Ties of the order within a source are rows of one doc_id and text: repeated rows take places of their own, next to each other.
    Nulls in text do not matter. Columns named block, slot or position are replaced.
    """
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("personal_data", redact),
    ("mixing", mix),
]

#: Trained models, sketches and learned patterns are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. Tables between are removed as soon as the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    before = made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        removed(spark, made()[len(before) : -1])
    return docs
