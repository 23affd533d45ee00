"""Acronyms as a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafgate.functions.text import deshout, shouted_words

BROADCAST_WORDS = 100_000


def deshouted(rows: DataFrame, key: str, acronyms: DataFrame, text: str = "text") -> DataFrame:
    """rows with text as deshout leaves it, where the words that stay are a table (column word). key: unique in rows.

    Only the shouted words of each row travel, with its key; the table is sent to all tasks up to BROADCAST_WORDS distinct words, else both meet by
    shuffle. Null texts stay null; null words are none; rows with a null key, which are not told apart, are calmed as if the table were empty.
    """
    known = acronyms.select("word").where("word is not null").distinct()
    if known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        known = F.broadcast(known)
    words = rows.select(F.col(key).alias("_key"), F.explode(shouted_words(F.col(text))).alias("word"))
    stay = words.join(known, "word", "left_semi").groupBy("_key").agg(F.collect_set("word").alias("_stay"))
    joined = rows.join(stay, F.col(key) == F.col("_key"), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn(text, deshout(F.col(text), F.coalesce("_stay", none))).drop("_key", "_stay")
