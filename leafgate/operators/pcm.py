"""Sampled sound as rows of blocks: trimmed, mixed down, resampled and stitched without a recording ever being one value.

A block is a row with the number of its first frame (`start`, from 0 in each recording) and its samples. Frames that no block has are silence.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from leafgate.functions.signal import wav_header

#: Of a voice sample: seconds that are skipped and kept, and its rate.
SKIP, SECONDS, RATE = 3.0, 15.0, 22050
#: Zero crossings of the filter on each side; frames of one block of results; bytes of one piece of a stitched payload.
ZEROS, FRAMES, PIECE = 16, 1 << 14, 64 << 20
#: Samples that a task resamples at once, about.
TASK_SAMPLES = 1 << 18
#: Bytes of a WAV header.
HEADER = 44


def mono(samples: Column, channels: int) -> Column:
    """The mean of the channels of each frame of interleaved samples; an unfinished last frame is dropped, a null sample is 0."""
    n = F.floor(F.size(samples) / channels).cast("int")
    one = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    frame = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda z, x: z + one(x)) / channels
    mixed = F.transform(samples, one) if channels == 1 else F.transform(F.sequence(F.lit(0), n - 1), frame)
    return F.when(n > 0, mixed).otherwise(F.array().cast("array<double>"))


def trimmed_blocks(blocks: DataFrame, start: str, samples: str, first: int, frames: int) -> DataFrame:
    """What blocks of one channel hold of so many frames from the first; start counts from there."""
    skip = F.greatest(F.lit(first) - F.col(start), F.lit(0))
    n = F.least(F.lit(first + frames) - F.col(start), F.size(samples)) - skip
    rows = blocks.withColumns({"_skip": skip, "_n": n}).where("_n > 0")  # null samples have no size above 0
    kept = {samples: F.slice(samples, (F.col("_skip") + 1).cast("int"), F.col("_n").cast("int")), start: F.col(start) + F.col("_skip") - first}
    return rows.withColumns(kept).drop("_skip", "_n")


def kernel(t: np.ndarray, cut: float, zeros: int = ZEROS) -> np.ndarray:
    """The windowed sinc at distances t (in frames of the input). cut: its band, 1 for all of the input's."""
    reach = zeros / cut
    return np.where(np.abs(t) < reach, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / reach)), 0.0)


def resampled(blocks: DataFrame, key: str, start: str, samples: str, rate: int, to: int, frames: int = FRAMES, zeros: int = ZEROS) -> DataFrame:
    """key, start, samples (array<double>) at another rate, in blocks of so many frames. blocks: of one channel, not overlapping.

    Result m stands at m * rate / to of the input and is the sum of the frames around it, weighted by a sinc under a Hann window of `zeros` crossings on each side; there are
    as many results as stand before the input's end. Each block of results is made by itself from the frames in its reach: input blocks go, cut, to every block that they
    touch, so a recording of any length spreads over tasks. A block of results that no frame reaches is left out, as silence.
    """
    common = gcd(rate, to)
    down, up = rate // common, to // common
    cut = min(1.0, up / down)
    half = ceil(zeros / cut)
    rows = blocks.select(F.col(key).alias("key"), F.col(start).cast("long").alias("s"), F.col(samples).cast("array<double>").alias("x"))
    rows = rows.where(F.size("x") > 0).withColumn("e", F.col("s") + F.size("x"))
    ends = rows.groupBy(F.col("key").alias("k")).agg(F.max("e").alias("n_in"))
    at = lambda frame: F.floor(frame * up / F.lit(down * frames)).cast("long")
    cells = F.sequence(F.greatest(at(F.col("s") - half - 1), F.lit(0)), at(F.col("e") + half))
    rows = rows.select("key", "s", "e", "x", F.explode(cells).alias("cell"))
    low = F.floor(F.col("cell") * frames * down / up).cast("long") - half
    high = F.floor(((F.col("cell") + 1) * frames - 1) * down / up).cast("long") + half + 2
    rows = rows.withColumns({"from": F.greatest("s", low), "n": F.least("e", high) - F.greatest("s", low)}).where("n > 0")
    rows = rows.select("key", "cell", F.col("from"), F.slice("x", (F.col("from") - F.col("s") + 1).cast("int"), F.col("n").cast("int")).alias("x"))
    rows = rows.join(ends, F.col("key").eqNullSafe(F.col("k"))).drop("k")
    # the rows of a block of results come one after the other, the first is marked
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "cell").orderBy("from")))
    taps = np.arange(-half, half + 2)

    def made(table: pa.Table) -> pa.RecordBatch:
        """The blocks of results of whole groups of rows."""
        first = np.flatnonzero(table["nth"].to_numpy() == 1)
        cell, n_in = (table[c].to_numpy()[first] for c in ("cell", "n_in"))
        m = cell[:, None] * frames + np.arange(frames)
        there = m < -(-n_in * up // down)[:, None]
        whole, phase = np.divmod(m * down, up)
        low = whole[:, 0] - half
        width = int((whole[:, -1] - low).max()) + half + 2
        lists = table["x"].combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(ends)
        row = np.repeat(np.arange(len(n)), n)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        at = (table["from"].to_numpy() - low[group])[row] + np.arange(len(row)) - (ends[:-1] - ends[0])[row]
        inside = at < width
        x = np.zeros(len(first) * width)
        x[(group[row] * width + at)[inside]] = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]][inside]
        phases, which = np.unique(phase, return_inverse=True)
        which = which.reshape(phase.shape)
        weights = kernel(phases[:, None] / up - taps, cut, zeros)
        base = whole - low[:, None] + np.arange(len(first))[:, None] * width
        y = np.zeros(m.shape)
        for i, tap in enumerate(taps):
            y += weights[which, i] * x[base + tap]
        some = there.any(1)
        sizes = np.append(0, np.cumsum(there.sum(1)[some]))
        samples = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(y[there]))
        keys = table["key"].take(pa.array(first[some])).combine_chunks()
        return pa.RecordBatch.from_arrays([keys, pa.array(cell[some] * frames), samples], ["key", "start", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, TASK_SAMPLES // (frames * max(1, -(-down // up)) + 2 * half))
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            first = np.flatnonzero(table["nth"].to_numpy() == 1)
            for low, high in zip(first[:-1:most], [*first[:-1][most::most], first[-1]]):  # the last group may go on
                yield made(table.slice(low, high - low))
            rest = table.slice(first[-1])
        if rest is not None:
            yield made(rest)

    schema = StructType([*rows.select("key").schema, *StructType.fromDDL("start long, samples array<double>")])
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), F.col("start").alias(start), F.col("samples").alias(samples))


def voice_sample(blocks: DataFrame, key: str, start: str, samples: str, rate: int, channels: int, skip: float = SKIP, seconds: float = SECONDS, to: int = RATE, frames: int = FRAMES) -> DataFrame:
    """A recording's reference for a voice: some seconds after the skipped ones, one channel, at a rate of its own. blocks: interleaved channels."""
    one = blocks.select(key, start, mono(F.col(samples), channels).alias(samples))
    return resampled(trimmed_blocks(one, start, samples, int(skip * rate), int(seconds * rate)), key, start, samples, rate, to, frames)


def stitched_pieces(files: DataFrame, by: str, name: str, content: str, piece: int = PIECE, rate: int | None = None, channels: int = 1) -> DataFrame:
    """by, piece_no (from 0), payload: the contents of the files of each `by` in the order of their names, one after the other, in pieces of so many bytes.

    Where each file begins is a running sum over lengths alone; then its bytes go, cut, to the pieces that they lie in, so no task holds more than a piece or a file.
    With a rate the whole is a WAV file: a header, made of the sums, comes first, and a zero byte after an odd number of bytes of sound.
    Null contents are empty. Names tell files of one `by` apart. A `by` without a byte has no pieces, and with a rate one.
    """
    rows = files.select(F.col(by).alias("b"), F.col(name).alias("f"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("c"))
    rows = rows.withColumn("n", F.octet_length("c").cast("long"))
    head = HEADER if rate else 0
    before = Window.partitionBy("b").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.select(F.col("b").alias("b2"), F.col("f").alias("f2"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + head).alias("at"))
    placed = rows.join(places, F.col("b").eqNullSafe(F.col("b2")) & F.col("f").eqNullSafe(F.col("f2"))).select("b", "at", "n", "c")
    if rate:
        total = rows.groupBy("b").agg(F.sum("n").alias("t"))
        first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(head).cast("long").alias("n"), wav_header(F.col("t"), rate, channels).alias("c"))
        pad = F.struct((F.col("t") + head).alias("at"), (F.col("t") % 2).alias("n"), F.lit(b"\x00").alias("c"))  # no byte after an even number
        placed = placed.unionByName(total.select("b", F.inline(F.array(first, pad))))  # at once: each branch would read the files again
    cut = placed.where("n > 0").withColumn("piece_no", F.explode(F.sequence(F.floor(F.col("at") / piece), F.floor((F.col("at") + F.col("n") - 1) / piece))))
    low = F.greatest(F.col("piece_no") * piece, F.col("at"))
    high = F.least((F.col("piece_no") + 1) * piece, F.col("at") + F.col("n"))
    cut = cut.select("b", "piece_no", low.alias("low"), F.substring("c", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("c"))
    return cut.groupBy(F.col("b").alias(by), "piece_no").agg(F.expr("listagg(c) within group (order by low)").alias("payload"))
