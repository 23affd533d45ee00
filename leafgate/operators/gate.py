"""The silence gate: blocks of a device become clips.

An audible block opens a clip. The first silent block after an audible one starts a timer; a silent block at least
`gap` later closes the clip and is its last. Silence outside a clip is dropped. This is no session
window: only a silent block closes, and the timer runs from the first silent block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafgate.functions.signal import pcm_seconds

LEVEL, GAP, LEAST = 200.0, 4.0, 2.0
#: Seconds of a device's blocks that one task has in order; blocks of 1,024 frames at 44.1 kHz are 155,000 an hour.
SPAN = 3600.0


def _carried(spans: DataFrame, key: str, gap: float) -> DataFrame:
    """What is known at the start of each span of a device: whether no clip is open (shut), since when it has been silent (since), how many
    clips there were (before), and whether the first audible block opens one (first). A row for each span with blocks, so a device may have its rows in one task."""
    by = Window.partitionBy(key).orderBy("_span")
    spans = spans.withColumn("_g", F.sum((F.col("_n") > 0).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # since the last span with an audible block: its last run, and the spans without any after it
    silent = Window.partitionBy(key, "_g").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumns({"_from": F.min("_last.s0").over(silent), "_to": F.max("_last.s1").over(silent)})
    spans = spans.withColumns({"_from": F.lag("_from").over(by), "_to": F.lag("_to").over(by), "_g": F.coalesce(F.lag("_g").over(by), F.lit(0))})
    spans = spans.withColumn("_shut", (F.col("_g") == 0) | F.coalesce(F.col("_to") - F.col("_from") >= gap, F.lit(False)))
    spans = spans.withColumn("_first", F.col("_shut") | F.coalesce(F.col("_lead.s1") - F.least("_from", "_lead.s0") >= gap, F.lit(False)))
    opens = F.col("_inside") + (F.col("_first") & (F.col("_n") > 0)).cast("long")
    spans = spans.withColumn("_before", F.coalesce(F.sum(opens).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spans.select(F.col(key).alias("_key"), F.col("_span").alias("_at"), "_shut", F.col("_from").alias("_since"), "_before", "_first")


def gate_blocks(blocks: DataFrame, key: str, order: list[str], ts: str, level: Column, threshold: float = LEVEL, gap: float = GAP, keep: list[str] | None = None, span: float = SPAN) -> DataFrame:
    """The blocks that belong to clips: key, order, ts, `keep`, clip_no (from 1), t (seconds), past (1: the block closes its clip).

    A device's blocks are cut into spans of time, which go to tasks of their own: each span is summed up (silence before its first audible block, silence after its last
    one, clips that open in between), the summaries of a device are carried over in order, and each span numbers its own blocks from what is carried to it. Where order does not
    begin with ts, a device is one span. Blocks without a level are none.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    names = list(dict.fromkeys([key, *order, ts, *(keep or [])]))
    at = F.coalesce(F.floor(seconds / span).cast("long"), F.lit(-(1 << 62))) if order[0] == ts else F.lit(0)
    ordered = Window.partitionBy(key, "_span").orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(key, "_span", "_run")
    rows = blocks.select(*names, (level >= threshold).alias("audible"), seconds.alias("t"), at.alias("_span")).where("audible is not null")
    rows = rows.withColumn("_run", F.sum(F.col("audible").cast("long")).over(so_far))  # 0: before the first audible block of the span
    silent = F.when(~F.col("audible"), F.col("t"))
    rows = rows.withColumn("_quiet", F.struct(F.min(silent).over(run).alias("s0"), F.max(silent).over(run).alias("s1")))
    shut = F.coalesce(F.col("_quiet.s1") - F.col("_quiet.s0") >= gap, F.lit(False))
    last = F.max_by("_quiet", "_run")
    spans = rows.groupBy(key, "_span").agg(
        F.max("_run").alias("_n"), F.max_by("_quiet", -F.col("_run")).alias("_lead"), F.min("_run").alias("_low"), last.alias("_last"),
        (F.count_if(F.col("audible") & shut) - ((F.max("_run") > 0) & F.coalesce(last["s1"] - last["s0"] >= gap, F.lit(False))).cast("long")).alias("_inside"),
    )
    spans = spans.withColumn("_lead", F.when(F.col("_low") == 0, F.col("_lead")))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at"))
    rows = rows.join(_carried(spans, key, gap), same).where("_run > 0 or not _shut")
    since = F.when(F.col("_run") == 0, F.least("_since", "_quiet.s0")).otherwise(F.col("_quiet.s0"))
    rows = rows.withColumn("past", (~F.col("audible") & (F.col("t") - since >= gap)).cast("long"))
    rows = rows.withColumn("nth", F.sum("past").over(run.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.col("audible") & F.when(F.col("_run") == 1, F.col("_first")).otherwise(F.lag("past").over(ordered) == 1)
    rows = rows.withColumn("_opens", opens.cast("long"))
    return rows.withColumn("clip_no", F.col("_before") + F.sum("_opens").over(so_far)).where("past = 0 or nth = 1").select(*names, "clip_no", "t", "past")


def gate_clips(blocks: DataFrame, key: str, order: list[str], ts: str, level: Column, threshold: float = LEVEL, gap: float = GAP, span: float = SPAN) -> DataFrame:
    """key, clip_no (from 1), start_ts, end_ts, n_blocks, seconds, closed. ts names a timestamp; order says how blocks of a key follow."""
    rows = gate_blocks(blocks, key, order, ts, level, threshold, gap, span=span)
    return rows.groupBy(key, "clip_no").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_blocks"), (F.max("t") - F.min("t")).alias("seconds"), (F.max("past") == 1).alias("closed"))


def clip_payloads(rows: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """key, clip_no, n_bytes, payload: the blocks' bytes in order. rows: of gate_blocks, with payload (binary) kept."""
    return rows.groupBy(key, "clip_no").agg(*_joined(order, payload))


def clip_audio(rows: DataFrame, key: str, order: list[str], payload: str, rate: str, channels: str) -> DataFrame:
    """clip_payloads with sample rate, channels and seconds: all that a writer of 16-bit PCM files needs. rate and channels, kept too, are of the clip's first block."""
    first = [F.min_by(c, F.struct(*order)).cast("int").alias(n) for c, n in ((rate, "rate"), (channels, "channels"))]
    out = rows.groupBy(key, "clip_no").agg(*_joined(order, payload), *first)
    return out.withColumn("seconds", pcm_seconds(F.col("n_bytes"), F.col("rate"), F.col("channels")))


def _joined(order: list[str], payload: str) -> list[Column]:
    by = ", ".join(f"`{c}`" for c in order)
    whole = F.coalesce(F.expr(f"listagg(`{payload}`) within group (order by {by})"), F.lit(b""))
    return [F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("n_bytes"), whole.alias("payload")]


def sample_blocks(samples: DataFrame, key: str, index: str, value: str, frames: int = 1024) -> DataFrame:
    """key, block_no, n, level: samples (index from 0) in blocks of so many, with the root of their mean square."""
    square = F.col(value).cast("double") * F.col(value).cast("double")
    return samples.groupBy(key, F.floor(F.col(index) / frames).cast("long").alias("block_no")).agg(F.count(value).alias("n"), F.coalesce(F.sqrt(F.avg(square)), F.lit(0.0)).alias("level"))


def long_enough(clips: DataFrame, least: float = LEAST) -> DataFrame:
    return clips.where(F.col("seconds") >= least)
