"""A stream of sound in rows of any length as blocks of one length.

Rows say at which frame they begin, so they may come in any order and more than once: what lies ahead waits in the device's state until what is missing has come, and what
has been taken before is dropped. What is left behind the last whole block is carried over to the next micro-batch. A row without pcm says
where a recording ends: the rest is then a shorter block, and nothing comes after it.

Rows come and go as such: of a device's few rows in a micro-batch, making pandas frames took more than cutting the blocks. Spark does not go on from a checkpoint
that the operator over pandas frames has written, though the state in it is the same: it fails and says so. Such a stream needs a new checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructType

from leafgate.streaming.ordered import stateful

BLOCK = "block_no long, n long, level double, pcm binary"
_TAKEN = StructType().add("next", LongType()).add("end", LongType()).add("rest", BinaryType())
_START, _PCM = StructType().add("start", LongType()), StructType().add("pcm", BinaryType())
#: Bytes of sound whose levels are taken at once, about.
LEVELLED = 1 << 16


def _levels(sound: bytes, whole: int) -> list[float]:
    """The levels of blocks of so many bytes, one after the other; the last may be shorter."""
    cut = len(sound) // whole * whole
    levels: list[float] = []
    for part, n in ((sound[:cut], whole), (sound[cut:], len(sound) - cut)):
        if part:
            samples = np.frombuffer(part, "<i2").astype(float).reshape(-1, n // 2)
            levels += np.sqrt(np.mean(np.square(samples), axis=1)).tolist()
    return levels


class _Blocks(StatefulProcessor):
    def __init__(self, frames: int, channels: int):
        self.frames, self.size = frames, 2 * channels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", _TAKEN)
        self.ahead = handle.getMapState("ahead", _START, _PCM)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, end, rest = self.taken.get() or (0, None, b"")
        rest = bytearray(rest or b"")
        waiting: dict[int, bytes] = {k[0]: bytes(v[0]) for k, v in self.ahead.iterator()}
        stored = dict(waiting)
        for row in rows:
            if row.pcm is None:
                end = row.start if end is None else end
            elif len(row.pcm) > len(waiting.get(row.start, b"")):
                waiting[row.start] = row.pcm
        for start in sorted(waiting):
            if start > at:
                break
            new = waiting.pop(start)
            new = new[: len(new) // self.size * self.size][(at - start) * self.size :]
            rest += new
            at += len(new) // self.size
        over = end is not None and at >= end
        if over:
            waiting.clear()
            del rest[max(0, len(rest) - (at - end) * self.size) :]
            at = end
        no = (at - len(rest) // self.size) // self.frames
        whole = self.frames * self.size
        ready = len(rest) if over else len(rest) // whole * whole
        for start in set(stored) - set(waiting):
            self.ahead.removeKey((start,))
        for start, new in waiting.items():
            if stored.get(start) != new:
                self.ahead.updateValue((start,), (new,))
        self.taken.update((at, end, bytes(rest[ready:])))
        step = max(1, LEVELLED // whole) * whole
        for low in range(0, ready, step):
            sound = bytes(rest[low : min(low + step, ready)])
            for i, level in enumerate(_levels(sound, whole)):
                pcm = sound[i * whole : (i + 1) * whole]
                yield Row(key=key[0], block_no=no + low // whole + i, n=len(pcm) // self.size, level=level, pcm=pcm)

    def close(self) -> None:
        pass


def block_stream(rows: DataFrame, key: str, start: str, pcm: str, frames: int = 1024, channels: int = 1) -> DataFrame:
    """key, block_no (from 0), n (frames), level (root of the mean square), pcm. rows: a stream; start is the number of a row's first frame, pcm 16-bit samples, or null at the recording's end.
    Rows without a start are dropped. Of rows with one start the longest counts."""
    stateful(rows.sparkSession)
    given = rows.select(F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(pcm).alias("pcm")).where("start is not null")
    schema = StructType([*given.select("key").schema, *StructType.fromDDL(BLOCK)])
    out = given.groupBy("key").transformWithState(_Blocks(frames, channels), schema, "append", "none")
    return out.withColumnRenamed("key", key)
