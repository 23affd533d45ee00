"""The work manifest: names, parts, what is done, and in which order results are stitched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leafgate.functions.text import safe_name, stem


def manifest(chapters: DataFrame, chunks: Column | None = None, n_chunks: Column | None = None) -> DataFrame:
    """book_id, chapter_no, title, n_chunks, fname. The number of chunks will do."""
    n = F.size(chunks) if n_chunks is None else n_chunks
    return chapters.select("book_id", "chapter_no", "title", n.cast("long").alias("n_chunks"), safe_name(F.col("chapter_no"), F.col("title")).alias("fname"))


#: What tells a result apart: file names are numbered anew in each book.
KEY = ("book_id", "fname")


def _keys(key: str | list[str] | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def pending(work: DataFrame, done: DataFrame, key: str | list[str] | tuple[str, ...] = KEY) -> DataFrame:
    """Work whose result is not there yet."""
    return work.join(done, _keys(key), "left_anti")


def finished(work: DataFrame, done: DataFrame, key: str | list[str] | tuple[str, ...] = KEY) -> DataFrame:
    return work.join(done, _keys(key), "left_semi")


def progress(work: DataFrame, done: DataFrame, key: str | list[str] | tuple[str, ...] = KEY, by: str = "book_id") -> DataFrame:
    """Per `by`: items, items done, chunks, chunks done. work has n_chunks; done may name a key more than once."""
    flags = work.join(done.select(*_keys(key)).distinct().withColumn("_done", F.lit(True)), _keys(key), "left")
    return flags.groupBy(by).agg(
        F.count("*").alias("n_items"), F.count_if("_done").alias("n_done"), F.sum("n_chunks").alias("n_chunks"), F.sum(F.when(F.col("_done"), F.col("n_chunks")).otherwise(0)).alias("chunks_done")
    )


def part_names(chunked: DataFrame) -> DataFrame:
    """chunked with the name of each chunk's part file."""
    return chunked.withColumn("part", F.format_string("%04d.wav", "chunk_no"))


def stitched(files: DataFrame, by: str, name: str = "fname", numeric: bool = False, fold: bool = False) -> DataFrame:
    """Per `by`: the files in the order of their names, as one list, and the output's name. numeric: by leading number first. fold: whatever the case, and of names that differ in case alone by code point."""
    order = [F.lower(name)] if fold else []
    order = [F.coalesce(F.regexp_extract(name, r"^(\d+)", 1).try_cast("long"), F.lit(0))] + order if numeric else order
    keyed = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col(name).alias("f"))))
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.array_join(F.transform(keyed, lambda x: x["f"]), "|").alias("files"), F.concat(F.first(stem(F.col(by))), F.lit("_full.mp3")).alias("output"))
