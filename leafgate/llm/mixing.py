"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash, make blocks of `block_size`. Target weights are
integer shares q of a period of Q slots (their sum), so weights are q / Q. Block k (from 0) of a
source may run from slot floor(k Q / q) on (its release) and must run before slot ceil((k+1) Q / q)
(its deadline). Slot after slot, of the released blocks that with the earliest deadline runs; ties
go to the source that sorts first. So at each slot each source has had its share up to less than
one block. The schedule repeats after Q slots, therefore one period is worked out, by a SQL fold
over the slots of one row, and each document finds its slot by arithmetic. A source that runs out
leaves its slots unused; `position` counts documents in the order of the slots without gaps.

Shares are made from the data by `temperature`: proportional to the number of documents to that
power (0.5 by default), in whole parts of about `resolution`, or of `PER_SOURCE` for each source if those are more, so
that many sources do not all come down to the least share of one. A
caller may pass shares instead: {source: share}; sources that it does not name have share one.

Only DataFrame and SQL functions are used. Hot sources are numbered in parts: buckets by the
leading digits of the hash are counted, the counts summed up, and documents numbered within their
bucket. The fold looks at each source in each slot, so its work grows with the square of the number of sources, not with the
documents. Up to `BROADCAST_SOURCES` sources the schedule says in each slot what every source has had, and documents find their position by
arithmetic; beyond, blocks are counted and the counts summed up in the order of slots.

Defined results: a null source is the source ''; null or equal doc_ids and repeated rows each keep
a place of their own, in the order of doc_id and text hash; nulls in text do not matter; an empty
table gives an empty result; extra columns are passed on by `mixed`, unless they have the names
of its results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK_SIZE = 8
RESOLUTION, PER_SOURCE = 240, 8
BUCKET_ROWS = 20_000
RESULTS = ("block", "slot", "position")
#: Up to so many sources the schedule (a row for each slot, with a count for each source) is sent to all tasks.
BROADCAST_SOURCES = 100
#: Slots of one range of the sums over slots.
SPAN = 1 << 14


def shares(counts: DataFrame, weights: dict[str, int] | None = None, temperature: float = 0.5, resolution: int = RESOLUTION) -> DataFrame:
    """src, n (documents), share. counts: src, n."""
    if weights is None:
        every = Window.partitionBy(F.lit(0))
        total = F.sum(F.pow("n", F.lit(temperature))).over(every)
        parts = F.greatest(F.lit(resolution), PER_SOURCE * F.count("*").over(every))
        share = F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(temperature)) * parts / total + 1e-9)).cast("long")
    else:
        share = F.lit(1)
        for source, w in weights.items():
            share = F.when(F.col("src") == source, w).otherwise(share)
    return counts.select("src", "n", share.cast("long").alias("share"))


#: One period as a fold over its slots, two steps each: the first picks the source, the second gives it the block. (A name for the picked source
#: within one step would be a lambda's argument, which Spark copies with all that is held.) In one row: q, the shares by place of the source; total, their sum.
#: The state: done, blocks given to each source; p, the picked one; out, of each slot so far its source, the number of its block, and, if `kept`, what each source had had before it.
PERIOD = """
aggregate(sequence(0L, 2 * total - 1L), named_struct('done', transform(q, x -> 0L), 'p', 0, 'out', cast(array() as array<struct<place: int, k: bigint, had: array<bigint>>>)),
  (s, t) -> if(t % 2 = 0,
    named_struct('done', s.done, 'p', array_min(transform(
        filter(sequence(0, size(q) - 1), i -> s.done[i] < q[i] and s.done[i] * total div q[i] <= t div 2),
        i -> struct((s.done[i] * total + total + q[i] - 1L) div q[i] as due, i as i))).i, 'out', s.out),
    named_struct('done', transform(s.done, (d, j) -> if(j = s.p, d + 1L, d)), 'p', s.p,
      'out', array_append(s.out, named_struct('place', s.p, 'k', s.done[s.p], 'had', if(kept, s.done, cast(array() as array<bigint>)))))),
  s -> s.out)
"""


def period(sources: DataFrame, kept: bool = True) -> DataFrame:
    """A row for each block of one period: src, k (from 0), slot, total (slots), and, if kept, ahead: blocks that each source has had before it."""
    row = sources.agg(F.array_sort(F.collect_list(F.struct("src", "share", "n"))).alias("all")).where(F.size("all") > 0)
    row = row.selectExpr("all", "transform(all, x -> x.share) as q", "aggregate(all, 0L, (a, x) -> a + x.share) as total", f"{kept} as kept").withColumn("out", F.expr(PERIOD))
    slots = row.select("all", "total", F.posexplode_outer("out").alias("slot", "x"))  # outer: else Spark puts the whole fold into a filter as well
    ahead = ["transform(all, (a, i) -> struct(a.share as share, a.n as n, x.had[i] as had)) as ahead"] if kept else []
    return slots.selectExpr("all[x.place].src as src", "x.k as k", "cast(slot as bigint) as slot", "total", *ahead)


def starts(blocks: DataFrame) -> DataFrame:
    """blocks (_src, _block, slot, n) with start: the documents of all slots before. Slots are summed in ranges first, so no window holds all blocks."""
    spans = blocks.withColumn("_span", F.expr(f"slot div {SPAN}"))
    sums = spans.groupBy("_span").agg(F.sum("n").alias("_sum"))
    sums = sums.select("_span", (F.sum("_sum").over(Window.orderBy("_span")) - F.col("_sum")).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_span").orderBy("slot")) - F.col("n")
    return spans.withColumn("_inside", inside).join(sums, "_span").select("_src", "_block", "slot", (F.col("_before") + F.col("_inside")).alias("start"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_size: int = BLOCK_SIZE, temperature: float = 0.5, resolution: int = RESOLUTION, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with block (its number in the source), slot and position."""
    kept = [c for c in docs.columns if c not in RESULTS]
    own = {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(kept)}  # names of the caller's columns can't clash with those below
    rows = docs.select(*(c.alias(n) for n, c in own.items()), F.coalesce("source", F.lit("")).alias("_src"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    keys = rows.groupBy("_src").agg(F.count("*").alias("n"))
    seen = keys.agg(F.max("n").alias("most"), F.count("*").alias("sources")).first()
    digits = 0
    while (seen["most"] or 0) > bucket_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    before = rows.groupBy("_src", "_b").agg(F.count("*").alias("_c"))
    before = before.select("_src", "_b", (F.sum("_c").over(Window.partitionBy("_src").orderBy("_b")) - F.col("_c")).alias("_before"))
    inside = Window.partitionBy("_src", "_b").orderBy("_h", "_id", "_t")
    rows = rows.withColumn("_r", F.row_number().over(inside)).join(before, ["_src", "_b"]).withColumn("_r", F.col("_r") - 1 + F.col("_before"))
    sources = shares(keys.select(F.col("_src").alias("src"), "n"), weights, temperature, resolution)
    few = seen["sources"] <= BROADCAST_SOURCES
    plan = period(sources, kept=few)
    plan = plan.select(F.col("src").alias("_src"), F.col("k").alias("_k"), F.col("slot").alias("_slot"), F.col("total").alias("_q"), *([F.col("ahead").alias("_ahead")] if few else []))
    quota = sources.select(F.col("src").alias("_src"), F.col("share").alias("_share"))
    rows = rows.withColumn("_block", F.expr(f"_r div {block_size}"))
    turns = {"_turn": F.expr("_block div _share"), "_k": F.expr("_block % _share")}
    slot = (F.col("_turn") * F.col("_q") + F.col("_slot")).alias("slot")
    if few:
        out = rows.join(F.broadcast(quota), "_src").withColumns(turns).join(F.broadcast(plan), ["_src", "_k"])
        start = F.expr(f"aggregate(_ahead, 0L, (a, x) -> a + least(x.n, {block_size} * (_turn * x.share + x.had)))")
    else:  # each block finds its slot, and the documents their block: no source is a key of a join of documents
        blocks = rows.groupBy("_src", "_block").agg(F.count("*").alias("n")).join(quota, "_src").withColumns(turns).join(plan, ["_src", "_k"])
        out, start, slot = rows.join(starts(blocks.select("_src", "_block", slot, "n")), ["_src", "_block"]), F.col("start"), F.col("slot")
    return out.select(*(F.col(n).alias(c) for n, c in zip(own, kept)), F.col("_block").alias("block"), slot, (start + F.expr(f"_r % {block_size}")).alias("position"))
