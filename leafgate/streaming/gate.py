"""The silence gate over a stream: state per device, clips as they close.

Event time replaces the clock. Blocks of a micro-batch are taken in the order of (ts, event) at once, so the micro-batches of a device must
follow each other in time; `leafgate.streaming.ordered` takes them in any order. A block without a level says that its device's stream has ended: the clip that is open then is emitted
from the state, and the device's state goes. `drain` finds open clips in batch mode, where no such block is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from leafgate.operators.gate import GAP, LEAST, LEVEL, gate_clips, long_enough

CLIP = "clip_no long, start_ts timestamp, end_ts timestamp, n_blocks long, seconds double, closed boolean"
STATE = "clip_no long, start_us long, silent_us long, last_us long, n_blocks long"


def gate_stream(blocks: DataFrame, key: str, ts: str, event: str, level: str, threshold: float = LEVEL, gap: float = GAP, least: float = LEAST, late: str = "1 hour") -> DataFrame:
    """key (of the type it has), clip_no, start_ts, end_ts, n_blocks, seconds, closed: clips of at least so many seconds. A stream with columns key, ts, event, level."""
    rows = blocks.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(event).alias("event"), (F.col(level) >= threshold).cast("int").alias("audible"))
    gap_us = int(gap * 1_000_000)
    schema = StructType([*rows.select("key").schema, *StructType.fromDDL(CLIP)])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, silent, last, n = state.get if state.exists else (0, None, None, None, 0)
        out = []

        def emit(end: int, closed: bool) -> None:
            if end - start >= least * 1_000_000:
                out.append((k[0], number, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n, (end - start) / 1e6, closed))

        ended = False
        for us, _, audible in sorted((t.value // 1000, e, -1 if pd.isna(a) else int(a)) for f in frames for t, e, a in zip(f["ts"], f["event"], f["audible"])):
            ended = audible < 0
            if ended:
                if start is not None:
                    emit(last, False)
                start, silent, n = None, None, 0
            elif audible:
                if start is None:
                    number, start, n = number + 1, us, 0
                silent, last, n = None, us, n + 1
            elif start is not None:
                n, last = n + 1, us
                if silent is None:
                    silent = us
                if us - silent >= gap_us:
                    emit(us, True)
                    start, silent, n = None, None, 0
        if ended:
            state.remove()
        else:
            state.update((number, start, silent, last, n))
        yield pd.DataFrame(out, columns=["key", "clip_no", "start_ts", "end_ts", "n_blocks", "seconds", "closed"])

    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def drain(blocks: DataFrame, key: str, order: list[str], ts: str, level: str, threshold: float = LEVEL, gap: float = GAP, least: float = LEAST) -> DataFrame:
    """The clips that are still open at the end, if long enough."""
    return long_enough(gate_clips(blocks, key, order, ts, F.col(level), threshold, gap).where("not closed"), least)
