"""The silence gate over a stream whose blocks come out of order.

A device's blocks wait in its state until the watermark has passed them; then they are taken in the order of (ts, event), whatever
micro-batch brought them. A block that comes after its place in that order has gone is dropped: it changes nothing. So as long as no block is later than `late`, the clips are those of
`gate_clips` over the same blocks. A block without a level ends its device's stream: the clip that is open then is emitted, and the state goes.

With `quiet`, a device without a block for so long in event time ends too: its open clip is emitted (closed is false) up to its last block, and its
state goes. Such a device starts anew, its clips from 1, when it is heard again.

Each device's state comes with its blocks in one Arrow pass. A task holds the waiting blocks of one device at a time: what `late` of its stream holds. Needs the RocksDB state store, which `stateful` sets for a session.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import NumericType, StructType

from leafgate.operators.gate import GAP, LEAST, LEVEL
from leafgate.streaming.gate import CLIP

STATE = "number long, start_us long, silent_us long, last_us long, n long, us array<long>, event array<string>, audible array<int>"
_NEW = (0, None, None, None, 0)


def stateful(spark: SparkSession) -> SparkSession:
    """spark, with the state store that state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _taken(key: object, blocks: list[tuple], machine: tuple, now: int, gap: int, least: int, quiet: int | None) -> tuple[tuple, list[tuple]]:
    """The machine and the clips after blocks of one device, in order: (us, event, audible), where audible is 1, 0, or -1 for the end of a stream."""
    number, start, silent, last, n = machine
    out: list[tuple] = []

    def emit(end: int, closed: bool) -> None:
        if end - start >= least:
            out.append((key, number, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n, (end - start) / 1e6, closed))

    # what has gone quiet ends before the next block, or now
    for us, _, audible in [*blocks, (now, "", None)]:
        gone = quiet is not None and last is not None and us - last >= quiet
        if gone or audible == -1:
            if start is not None:
                emit(last, False)
            number, start, silent, last, n = _NEW
        if audible is None or audible == -1:
            continue
        last = us
        if audible:
            if start is None:
                number, start, n = number + 1, us, 0
            silent, n = None, n + 1
        elif start is not None:
            silent, n = us if silent is None else silent, n + 1
            if us - silent >= gap:
                emit(us, True)
                start, silent, n = None, None, 0
    return (number, start, silent, last, n), out


def ordered_gate_stream(
    blocks: DataFrame, key: str, ts: str, event: str, level: str, threshold: float = LEVEL, gap: float = GAP, least: float = LEAST, late: str = "1 hour", quiet: float | None = None
) -> DataFrame:
    """key (of the type it has), clip_no, start_ts, end_ts, n_blocks, seconds, closed: clips of at least so many seconds. A stream with columns key, ts, event, level.

    late: how far behind the newest block of any device a block may come. quiet: seconds without a block after which a device has ended.
    Blocks of one time come in the order of event (numbers as numbers; null first); blocks without a time are dropped.
    """
    number = isinstance(blocks.schema[event].dataType, NumericType)
    name = F.lpad(F.col(event).cast("string"), 20, "0") if number else F.col(event).cast("string")
    audible = F.when(F.col(level).isNull(), -1).otherwise((F.col(level) >= threshold).cast("int"))
    rows = blocks.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(name, F.lit("")).alias("event"), audible.alias("audible"))
    schema = StructType([*rows.select("key").schema, *StructType.fromDDL(CLIP)])
    gap_us, least_us, quiet_us = (None if x is None else int(x * 1_000_000) for x in (gap, least, quiet))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = max(0, state.getCurrentWatermarkMs()) * 1000
        *machine, us, event, audible = state.get if state.exists else (*_NEW, [], [], [])
        waiting = list(zip(us, event, audible))
        for f in () if state.hasTimedOut else frames:
            waiting += [b for b in zip(f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), f["event"], f["audible"].astype(int).tolist()) if b[0] > now]
        waiting.sort()
        n_due = bisect_right(waiting, now, key=lambda b: b[0])
        machine, out = _taken(k[0], waiting[:n_due], tuple(machine), now, gap_us, least_us, quiet_us)
        later = waiting[n_due:]
        if later or machine[3] is not None:
            state.update((*machine, *(list(c) for c in zip(*later))) if later else (*machine, [], [], []))
            wakes = [later[0][0]] if later else []
            if quiet_us is not None and machine[3] is not None:
                wakes.append(machine[3] + quiet_us)
            if wakes:  # fires when the watermark is beyond the time set
                state.setTimeoutTimestamp(max(1, now // 1000, -(-min(wakes) // 1000) - 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "clip_no", "start_ts", "end_ts", "n_blocks", "seconds", "closed"])

    stateful(blocks.sparkSession)
    return rows.where("ts is not null").withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
