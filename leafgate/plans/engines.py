"""Speech engines are the caller's: a registry of named makers, run over chunks in Arrow batches.

An engine is made once for each task and turns one chunk into audio bytes. None is built in; codecs and models need programs,
devices or networks that this library does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Engine = Callable[[str], bytes]


@dataclass(frozen=True)
class Settings:
    """Limits of an engine's chunks, and whether it needs a voice."""

    make: Callable[[str | None], Engine]
    unit: str = "chars"
    size: int = 4000
    needs_voice: bool = False


_engines: dict[str, Settings] = {}


def register(name: str, settings: Settings) -> None:
    _engines[name] = settings


def settings(name: str, voice: str | None = None) -> Settings:
    if name not in _engines:
        raise NotImplementedError(f"no engine named {name!r} is registered")
    if _engines[name].needs_voice and not voice:
        raise ValueError(f"{name} needs a voice")
    return _engines[name]


def synthesised(chunks: DataFrame, name: str, voice: str | None = None) -> DataFrame:
    """chunks (book_id, chapter_no, chunk_no, chunk) with audio (bytes) in place of chunk."""
    make = settings(name, voice).make

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make(voice)
        for batch in batches:
            yield batch[["book_id", "chapter_no", "chunk_no"]].assign(audio=[engine(c) for c in batch["chunk"]])

    return chunks.select("book_id", "chapter_no", "chunk_no", "chunk").mapInPandas(run, "book_id string, chapter_no int, chunk_no int, audio binary")
