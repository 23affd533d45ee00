"""Greedy chunks of sentences, bounded by characters or words. A longer sentence stays whole.

What a chunk holds depends on all sentences before it, so this is one Arrow pass over the texts, linear in their length. Of a batch of texts only some
are taken apart at a time.
White space is all of Unicode's. A null text is empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHARS, WORDS = 4000, 200
#: Characters of the texts that are in chunks at one time in a task, about.
PART_CHARS = 1 << 20
BETWEEN = re.compile(r"(?<=[.!?])\s+")


def _grouped(sentences: list[str], sizes: list[int], most: int, gap: int = 0) -> list[list[str]]:
    """Sentences in order, a new group where one more would be beyond `most`. gap: what each one held adds to its size."""
    out: list[list[str]] = []
    used = 0
    for s, n in zip(sentences, sizes):
        if not out or used + n > most:
            out.append([])
            used = 0
        out[-1].append(s)
        used += n + gap
    return out


def _chunks_by_chars(text: str, size: int) -> list[str]:
    sentences = BETWEEN.split(text)
    return [c for g in _grouped(sentences, list(map(len, sentences)), size, gap=1) if (c := " ".join(g).strip())]


def _chunks_by_words(text: str, most: int) -> list[str]:
    sentences = BETWEEN.split(text)
    return [" ".join(g) for g in _grouped(sentences, [len(s.split()) for s in sentences], most)]


def _over(chunks: Callable[[str, int], list[str]], text: Column, most: int) -> Column:
    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _parts(batch):
                yield pa.array([chunks(t or "", most) for t in part], pa.list_(pa.string()))

    return run(text)


def _counted(chunks: Callable[[str, int], list[str]], text: Column, most: int) -> Column:
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([len(chunks(t.as_py() or "", most)) for t in batch], pa.int64())

    return run(text)


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, so many at a time that they are about PART_CHARS; one at least."""
    part, used = [], 0
    for t in texts:
        t = t.as_py()
        part.append(t)
        used += len(t or "")
        if used >= PART_CHARS:
            yield part
            part, used = [], 0
    if part:
        yield part


def by_chars(text: Column, size: int = CHARS) -> Column:
    """Chunks are stripped; an empty text has none."""
    return _over(_chunks_by_chars, text, size)


def by_words(text: Column, most: int = WORDS) -> Column:
    """Sentences of a chunk are joined by one space and not stripped; an empty text has one empty chunk."""
    return _over(_chunks_by_words, text, most)


def n_by_chars(text: Column, size: int = CHARS) -> Column:
    """How many chunks by_chars makes; they stay in the task."""
    return _counted(_chunks_by_chars, text, size)


def n_by_words(text: Column, most: int = WORDS) -> Column:
    return _counted(_chunks_by_words, text, most)


def chunked(rows: DataFrame, chunks: Column) -> DataFrame:
    """A row for each chunk: rows' other columns, chunk_no (from 0), chunk."""
    return rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(chunks).alias("chunk_no", "chunk"))
