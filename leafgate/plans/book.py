"""From pages to the work manifest, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leafgate.functions.text import clean
from leafgate.operators import chapters as ch, chunks, lines as ln, manifest as mf
from leafgate.plans import engines


@dataclass(frozen=True)
class Settings:
    """What a conversion is told: the unit and size of chunks, or the engine that sets them, and its voice."""

    unit: str = "words"
    size: int | None = None
    engine: str | None = None
    voice: str | None = None
    keep_headings: bool = False

    def checked(self) -> Settings:
        """With the engine's limits filled in. Unknown units, sizes below one and an engine without the voice it needs are errors."""
        own = self
        if self.engine is not None:
            limits = engines.settings(self.engine, self.voice)
            own = Settings(limits.unit, self.size or limits.size, self.engine, self.voice, self.keep_headings)
        if own.unit not in ("words", "chars"):
            raise ValueError(f"unit must be words or chars, not {own.unit!r}")
        if own.size is not None and own.size < 1:
            raise ValueError(f"size must be 1 or more, not {own.size}")
        return own

    def chunks(self, text: Column) -> Column:
        own = self.checked()
        return chunks.by_words(text, own.size or chunks.WORDS) if own.unit == "words" else chunks.by_chars(text, own.size or chunks.CHARS)

    def n_chunks(self, text: Column) -> Column:
        own = self.checked()
        return chunks.n_by_words(text, own.size or chunks.WORDS) if own.unit == "words" else chunks.n_by_chars(text, own.size or chunks.CHARS)


def cleaned_chapters(pages: DataFrame, keep_headings: bool = False) -> DataFrame:
    rows = ln.strip_repeated(ln.lines(pages), keep_headings=keep_headings, repeated=ln.repeated_of_pages(pages))  # a page is a row
    return ch.chapters(rows).withColumn("text", clean(F.col("text")))


def work(pages: DataFrame, unit: str = "words", size: int | None = None, settings: Settings | None = None) -> DataFrame:
    """The manifest of all books."""
    own = (settings or Settings(unit, size)).checked()
    return mf.manifest(cleaned_chapters(pages, own.keep_headings), n_chunks=own.n_chunks(F.col("text")))
