"""Sharding by a minimax contiguous partition.

Documents of equal text are one group and stay together. Groups come in the order of a hash of their text; those with
the same `digits` leading hexadecimal digits make one atom, so there are 16**digits atoms at most (65,536), whatever the
size of the input, and their sizes fit one row. Over the ordered sizes the smallest capacity is found by binary search for
which a greedy walk, which opens a new shard where the next atom does not fit, needs no more shards than there are. Then
the atoms are cut: no shard beyond that capacity, and within it each cut is at the end of an atom next to an even share of what is left,
unless the rest would not fit the shards left. So the largest shard is as small as it can be with these atoms, and
no larger than an even share and the largest atom.

Size: UTF-8 bytes of the text and OVERHEAD. Within a shard, rows have slots from 0 without gaps, in the order of a hash of doc_id
and text; they are numbered in parts (bucket by bucket of that hash), so a shard or a group with a third of all rows is no single task.

Only DataFrame and SQL functions are used.

Defined results: a null text is the empty text (size OVERHEAD, crc32 of no bytes, 0); null doc_ids are allowed; repeated rows have a slot each, next to
each other; texts are hashed whole, however long; an empty table gives an empty result; fewer groups than shards leave shards empty; extra columns are passed on
by `sharded`, unless they have the names of its results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from leafgate.llm.tables import written

SHARDS, DIGITS, OVERHEAD, BUCKET_ROWS = 40, 4, 16, 20_000
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")

#: Shards that a greedy walk over the sizes needs. A size beyond the capacity needs more than there are.
_NEEDED = """aggregate(atoms, named_struct('used', 1L, 'fill', 0L),
    (s, x) -> if(s.fill + x.bytes <= c, named_struct('used', s.used, 'fill', s.fill + x.bytes), named_struct('used', s.used + if(x.bytes <= c, 1L, 1000000L), 'fill', x.bytes)),
    s -> s.used)"""
#: The smallest capacity, by halving from (even share or largest atom) to all. One row: atoms, total.
_CAPACITY = """aggregate(sequence(1, 63), named_struct('lo', greatest(total div {k} + if(total % {k} > 0, 1L, 0L), array_max(transform(atoms, x -> x.bytes))), 'hi', total),
  (r, i) -> if(r.lo >= r.hi, r, transform(array((r.lo + r.hi) div 2L), c -> if({needed} <= {k}, named_struct('lo', r.lo, 'hi', c), named_struct('lo', c + 1L, 'hi', r.hi)))[0]),
  r -> r.hi)"""
#: From the end: where the last shard, the last two shards .. start at the earliest.
_LATEST = """aggregate(reverse(atoms), named_struct('fill', 0L, 'at', total, 'starts', cast(array() as array<bigint>)),
  (s, x) -> if(s.fill + x.bytes <= capacity, named_struct('fill', s.fill + x.bytes, 'at', s.at - x.bytes, 'starts', s.starts), named_struct('fill', x.bytes, 'at', s.at - x.bytes, 'starts', array_append(s.starts, s.at))),
  s -> s.starts)"""
#: The first atom of each shard but the first.
_CUTS = """aggregate(atoms, named_struct('at', 0L, 'start', 0L, 'goal', total div {k}, 'cuts', cast(array() as array<string>)),
  (s, x) -> if(size(s.cuts) < {k} - 1 and s.at > s.start and (s.at + x.bytes - s.start > capacity
      or (2L * s.at + x.bytes > 2L * s.goal and s.at >= coalesce(get(latest, {k} - 2 - size(s.cuts)), 0L))),
    named_struct('at', s.at + x.bytes, 'start', s.at, 'goal', s.at + (total - s.at) div ({k} - size(s.cuts) - 1), 'cuts', array_append(s.cuts, x.atom)),
    named_struct('at', s.at + x.bytes, 'start', s.start, 'goal', s.goal, 'cuts', s.cuts)),
  s -> s.cuts)"""


def partition(atoms: DataFrame, shards: int = SHARDS) -> DataFrame:
    """atom, shard. atoms: atom (string, their order), bytes. One task works on the row of all sizes, which is bounded by the number of atoms."""
    row = atoms.agg(F.array_sort(F.collect_list(F.struct("atom", "bytes"))).alias("atoms"), F.sum("bytes").alias("total")).where("total is not null")
    row = row.withColumn("capacity", F.expr(_CAPACITY.format(k=shards, needed=_NEEDED)))
    row = row.withColumn("latest", F.expr(_LATEST)).withColumn("cuts", F.expr(_CUTS.format(k=shards)))
    return row.select("cuts", "capacity", F.explode("atoms").alias("x")).select("x.atom", F.expr("size(filter(cuts, c -> c <= x.atom))").alias("shard"), "capacity")


def keyed(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """docs' columns under own names (_c0, ..) with _size, _crc, _atom, _k (the order in a shard) and _id."""
    kept = [c for c in docs.columns if c not in RESULTS]
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*own, F.col("doc_id").alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.md5(text.cast("binary")).alias("_h"))
    k = F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_h")))
    return rows.withColumns({"_atom": F.substring("_h", 1, digits), "_k": k}).drop("_h")


def sharded(docs: DataFrame, shards: int = SHARDS, digits: int = DIGITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: more shards are cut anew)."""
    kept = [c for c in docs.columns if c not in RESULTS]
    rows = keyed(docs, digits)
    keys = written(rows.select("_size", "_atom", F.substring("_k", 1, 8).alias("_k8")), "shard-keys")  # texts are read once for these, and once for the result
    sizes = written(keys.groupBy("_atom").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")), "shard-atoms")
    placed = written(partition(sizes.select(F.col("_atom").alias("atom"), "bytes"), shards).withColumnRenamed("atom", "_atom").drop("capacity"), "shard-map")
    most = sizes.join(placed, "_atom").groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    width = 0
    while most > bucket_rows * 16**width:
        width += 1
    placed = F.broadcast(placed)  # 16**digits short rows at most
    counts = keys.join(placed, "_atom").groupBy("shard", F.substring("_k8", 1, width).alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("shard", "_b").orderBy("_k", "_id")
    out = rows.join(placed, "_atom").withColumn("_b", F.substring("_k", 1, width)).withColumn("_r", F.row_number().over(inside)).join(before, ["shard", "_b"])
    return out.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_before") + F.col("_r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """The rows of `sharded` as Parquet: a folder for each shard, and in it a file for each run of so many slots."""
    run = F.expr(f"slot div {rows_per_file}L")
    rows.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
