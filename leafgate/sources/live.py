"""Recordings that are still being written, as a stream of blocks: a Spark data source with offsets.

A folder holds a file of 16-bit PCM for each device (`*.pcm`, or `*.wav` whose header may still say that it is empty). What the files have grown by since the last
micro-batch comes as blocks of `frames` frames; what is left behind the last whole block waits. A file beside it with `.end` added to its name says
that a recording is over: then its rest comes as a shorter block, and after it a row without pcm. Bytes that make no whole frame are dropped there.

The offset is how far each file has been read, so a stream that is started again goes on where its checkpoint ends, and a lost task reads its ranges once more. Ranges of
at most `span` blocks are dealt to tasks by their bytes and what a file costs to open, so many short recordings share a task and a long one has many. A file `name_20240131_235959.pcm` begins at that time (UTC), others at 1970; a block's ts is that of its first frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructType, TimestampType, BinaryType

from leafgate.sources.named import _store

FRAMES, SPAN = 1024, 4096
#: Bytes of one task's ranges, about; what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 4 << 20, 16 << 10
_STARTED = re.compile(r"_(\d{8}_\d{6})$")


@dataclass
class _Range:
    """Frames of a file, from and to; over: nothing comes after them."""

    name: str
    low: int
    high: int
    over: bool


@dataclass
class _Ranges(InputPartition):
    """What one task reads."""

    ranges: list[_Range]


def data_start(head: bytes) -> int | None:
    """Where the sound begins in a WAV file; None if that is not written yet."""
    at = 12
    while at + 8 <= len(head):
        if head[at : at + 4] == b"data":
            return at + 8
        size = int.from_bytes(head[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    return None


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.rate, self.channels = int(options.get("rate", 44100)), int(options.get("channels", 2))
        self.frames, self.span = int(options.get("frames", FRAMES)), int(options.get("span", SPAN))

    def initialOffset(self) -> dict:
        return {}

    def _begin(self, store, at: str) -> int | None:
        if not at.endswith(".wav"):
            return 0
        with store.open_input_stream(at) as f:
            return data_start(f.read(1 << 16))

    def latestOffset(self) -> dict:
        """Of each file: frames that can be read, and whether it is over."""
        from pyarrow.fs import FileSelector

        store, at = _store(self.path)
        found = {f.base_name: f.size for f in store.get_file_info(FileSelector(at)) if f.is_file}
        out = {}
        for name in sorted(n for n in found if n.endswith((".pcm", ".wav"))):
            begin = self._begin(store, f"{at}/{name}")
            n = 0 if begin is None else max(0, found[name] - begin) // (2 * self.channels)
            over = f"{name}.end" in found
            out[name] = [n if over else n // self.frames * self.frames, int(over)]
        return out

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        tasks, room = [], 0
        for one in self._ranges(start, end):
            cost = OPEN_BYTES + (one.high - one.low) * 2 * self.channels
            if not tasks or cost > room:
                tasks.append(_Ranges([]))
                room = TASK_BYTES
            tasks[-1].ranges.append(one)
            room -= cost
        return tasks

    def _ranges(self, start: dict, end: dict) -> Iterator[_Range]:
        for name, (high, over) in end.items():
            low, was_over = start.get(name, (0, 0))
            step = self.frames * self.span
            cuts = [*range(low, high, step), high] if high > low else []
            for a, b in zip(cuts, cuts[1:]):
                yield _Range(name, a, b, False)
            if over and not was_over:
                yield _Range(name, high, high, True)

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        store, at = _store(self.path)
        for one in partition.ranges:
            yield from self._read(store, at, one)

    def _read(self, store, at: str, partition: _Range) -> Iterator[tuple]:
        device = partition.name.rpartition(".")[0]
        named = _STARTED.search(device)
        begun = datetime.strptime(named[1], "%Y%m%d_%H%M%S").replace(tzinfo=timezone.utc) if named else datetime(1970, 1, 1, tzinfo=timezone.utc)
        time = lambda frame: begun + timedelta(microseconds=frame * 1_000_000 // self.rate)
        if partition.over:
            yield device, time(partition.high), partition.high, None, self.rate, self.channels
            return
        size = 2 * self.channels
        begin = self._begin(store, f"{at}/{partition.name}") or 0
        with store.open_input_file(f"{at}/{partition.name}") as f:
            f.seek(begin + partition.low * size)
            for frame in range(partition.low, partition.high, self.frames):
                pcm = f.read((min(frame + self.frames, partition.high) - frame) * size)
                yield device, time(frame), frame, pcm, self.rate, self.channels

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class GrowingSound(DataSource):
    """Format growing_sound, for streams. Options: path, rate, channels, frames, span."""

    @classmethod
    def name(cls) -> str:
        return "growing_sound"

    def schema(self) -> StructType:
        out = StructType().add("device", StringType()).add("ts", TimestampType()).add("start", LongType())
        return out.add("pcm", BinaryType()).add("rate", IntegerType()).add("channels", IntegerType())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def sound_stream(spark: SparkSession, folder: str, rate: int = 44100, channels: int = 2, frames: int = FRAMES) -> DataFrame:
    """device, ts, start (the block's first frame), pcm, rate, channels: the recordings in a folder while they grow."""
    spark.dataSource.register(GrowingSound)
    return spark.readStream.format("growing_sound").option("rate", rate).option("channels", channels).option("frames", frames).load(folder)
