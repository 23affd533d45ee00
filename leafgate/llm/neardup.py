"""Near-duplicates by Order MinHash.

Words are split at white space. Each run of five words is a k-mer, labelled with how many equal ones
come before it, so that labels do not repeat in a text. For each of `BANDS` hash functions a sketch
takes the `TAKE` smallest labels and hashes them in text order: texts agree on a sketch about as often as
they share those k-mers in the same order. Two texts are near copies if the k-mers that a banded
alignment matches in order are at least `threshold` of all k-mers of both (with matches counted once).
The band leaves out no alignment that could reach the threshold. With 0.8 and 16 sketches of three, a pair at
the threshold shares none with a probability below 0.0001.

Exact copies are one text from the start. In each group of texts that share a sketch, every text
is compared with two leaders: the text that shares most sketches with others, and the first by a hash that differs by band;
and with the first of those that share the next one, two or three sketches too. So the number of compared pairs follows the number
of members, not its square, where the members are copies of one text. What that leaves apart is compared in full: in each
group that still holds more than one component, all pairs of different components, blocks of about `TOGETHER` members
against each other. So any two near copies that share a sketch are in one class. Classes are the connected components.

The text of a leader is dealt to as many tasks as its members need, and a group's blocks to as many as they are, so a group
may hold any part of all rows; one of n different texts that are no copies costs n * n / 2 comparisons. Components cut their lineage by tables in the shared folder.

Defined results: fewer than five words are one k-mer; a null or wordless text is in a class of its
own; equal texts share a class; rows with one doc_id are one document, and a null doc_id stands in a class
by itself (null class); the class id is the smallest doc_id of the class; extra columns are ignored
(query) or passed on (stage, which keeps all rows of the smallest doc_id of each class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafgate.llm.tables import written
from leafgate.llm.textarrays import NON_SPACE, Texts, U, Words, chunks, mix, texts_of

K, TAKE, BANDS, THRESHOLD = 5, 3, 16, 0.8
PER_TASK = 200
#: Members, and bytes of their texts, of one block of a group that is compared in full; bytes of a bucket of pairs of blocks.
TOGETHER, BLOCK_BYTES, BUCKET_BYTES = 500, 4 << 20, 8 << 20
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def labels(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes in text order, and the text of each. A text of fewer words has one."""
    grams, whole = words.windows(k)
    at = np.flatnonzero(whole)
    hashes, doc = grams[at], words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        tail = np.array([int(mix(np.array([hash_of(words.hash[words.first[d] : words.first[d + 1]])], U))[0]) for d in short], U)
        hashes, doc = np.concatenate([hashes, tail]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    order = np.lexsort((hashes, doc))  # stable: equal ones keep their text order
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    times = np.empty(len(h), U)
    times[order] = (np.arange(len(h)) - first).astype(U)
    return mix(hashes + times * U(0xC2B2AE3D27D4EB4F)), doc


def hash_of(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes:
        out = (out * 0x100000001B3 ^ int(h)) & 0xFFFFFFFFFFFFFFFF
    return out


def sketches(label: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have labels, and their sketches (text, band)."""
    first = np.searchsorted(doc, np.arange(n + 1))
    some = np.flatnonzero(np.diff(first))
    out = np.empty((len(some), BANDS), U)
    if not len(some):
        return some, out
    starts = first[some]
    size = first[some + 1] - starts
    owner = np.repeat(np.arange(len(some)), size)
    for b in range(BANDS):
        value = mix(label ^ _SEEDS[b])
        left = value.copy()
        picks = []
        for _ in range(TAKE):
            low = np.minimum.reduceat(left, starts)
            at = np.flatnonzero(left == low[owner])
            at = at[np.unique(owner[at], return_index=True)[1]]
            picks.append(np.where(low == U(0xFFFFFFFFFFFFFFFF), -1, at))
            left[at] = U(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.stack(picks), axis=0)
        h = np.full(len(some), b + 1, U)
        for p in places:
            h = mix(h * U(0x9E3779B97F4A7C15) + np.where(p < 0, U(0), label[np.maximum(p, 0)]))
        out[:, b] = h
    return some, out


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of the labels of both that a banded alignment matches in order."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    slack = int((len(a) + len(b)) * (1 - threshold) / (1 + threshold)) + 1  # unmatched labels at the threshold: the band
    near = np.abs(i - j) <= slack
    j = j[near][np.argsort(i[near])]
    if (len(j) / (len(a) + len(b) - len(j))) < threshold:
        return len(j) / (len(a) + len(b) - len(j))
    m = len(j)
    if not (np.diff(j) > 0).all():
        tails = np.empty(len(j), np.int64)
        m = 0
        for x in j:
            at = int(np.searchsorted(tails[:m], x))
            tails[at] = x
            m = max(m, at + 1)
    return m / (len(a) + len(b) - m)


def _sketched(texts: DataFrame) -> DataFrame:
    """id, sketches and bytes of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in chunks(batches):
            some, sk = sketches(*labels(Words(t, NON_SPACE)), t.n)
            ids = batch.column("doc_id").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(sk.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64())), pa.array(np.diff(t.offs)[some].astype(np.int64))], ["id", "sketches", "bytes"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, sketches array<long>, bytes long")


def _pairs(sketched: DataFrame) -> DataFrame:
    """id, leader: the pairs to compare."""
    each = sketched.select("id", F.posexplode("sketches").alias("band", "sketch"))
    groups = each.groupBy("band", "sketch").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(groups, ["band", "sketch"]).groupBy("id").agg(F.sum("n").alias("near"))
    members = written(sketched.join(shared, "id"), "members")
    at = lambda b, d: f"sketches[({b} + {d}) % {BANDS}]"
    keys = []
    for b in range(BANDS):
        by_hash = f"xxhash64(id, {b})"
        keys.append(f"struct(xxhash64({b}, {at(b, 0)}) as key, 0 as way, -near as first)")
        for depth in (1, 2, 3, 4):
            keys.append(f"struct(xxhash64({b}, {', '.join(at(b, d) for d in range(depth))}) as key, {depth} as way, {by_hash} as first)")
    rows = members.select("id", F.explode(F.expr(f"array({', '.join(keys)})")).alias("k")).select("id", "k.key", "k.way", "k.first")
    leaders = rows.groupBy("key", "way").agg(F.min(F.struct("first", "id")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    leaders = leaders.select("key", "way", F.col("lead.id").alias("leader"))
    led = rows.join(leaders, ["key", "way"]).where("id != leader")
    return led.select(F.greatest("id", "leader").alias("id"), F.least("id", "leader").alias("leader")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of id, leader pairs: those that match. Each leader's text goes to the tasks of its members in parts."""
    parts = pairs.groupBy("leader").agg((F.floor(F.count("*") / PER_TASK) + 1).cast("int").alias("parts"))
    leaders = texts.join(parts, texts.doc_id == parts.leader).select("leader", F.col("text").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    own = pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
    both = own.join(texts, own.id == texts.doc_id).select("id", "leader", "part", "text").join(leaders.drop("parts"), ["leader", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch, t in chunks(batches):
            label, doc = labels(Words(t, NON_SPACE))
            first = np.searchsorted(doc, np.arange(t.n + 1))
            ok = np.zeros(t.n, bool)
            leaders = batch.column("leader").to_pylist()
            for i in range(t.n):
                if kept[0] != leaders[i]:
                    kept = (leaders[i], labels(Words(texts_of(batch.column("other").slice(i, 1)), NON_SPACE))[0])
                ok[i] = similarity(label[first[i] : first[i + 1]], kept[1], threshold) >= threshold
            yield batch.select(["id", "leader"]).filter(pa.array(ok))

    return both.sortWithinPartitions("leader", "part").mapInArrow(run, "id long, leader long")


def components(edges: DataFrame) -> DataFrame:
    """id, class of every id in edges (id, leader): its component's smallest id. Large and small stars in turn, until nothing changes."""
    edges = written(edges.select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")).where("u != v").distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest neighbours are written before they are joined: so the join reads two shuffles of its own, and Spark splits the rows of a hot centre
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = written(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = written(small, "stars")
        # a star forest: no id is both a centre and a point, and no point has two centres
        done = after.groupBy("u").count().where("count > 1").limit(1).count() == 0 and after.join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0
        edges = after
        if done:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))


def _across(sketched: DataFrame, named: DataFrame, docs: DataFrame, threshold: float) -> DataFrame | None:
    """Links between texts that share a sketch and are in different components so far. named: id, class."""
    each = sketched.join(named.hint("merge"), "id", "left").select("id", F.coalesce("class", "id").alias("class"), "bytes", F.posexplode("sketches").alias("band", "sketch"))
    blocks = F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    groups = each.groupBy("band", "sketch").agg(blocks, F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
    groups = groups.where("n > 2 and low < high").select("band", "sketch", "blocks")  # of two, one has led
    members = written(each.join(groups.hint("merge"), ["band", "sketch"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, band), blocks) as int)")), "apart")
    size = members.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0]
    if size is None:
        return None
    buckets = int(size / BUCKET_BYTES) + 8
    dealt = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"i": F.least("block", "other"), "k": F.greatest("block", "other")})
    texts = docs.join(members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = written(texts.join(sketched.select("id", "sketches").hint("merge"), F.col("doc_id") == F.col("id")).select("id", "sketches", "text"), "texts")
    dealt = dealt.select("id", "class", "band", "sketch", "block", "i", "k").join(texts.hint("merge"), "id")

    def meet(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("band", "sketch", "i", "k")])
        order = np.lexsort(keys)
        cut = np.flatnonzero((keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)) + 1
        found: list[tuple[int, int]] = []
        for at in np.split(order, cut):
            part = table.take(pa.array(at)).combine_chunks()
            ids, own, block, (band, _, i, k) = part["id"].to_numpy(), part["class"].to_numpy().copy(), part["block"].to_numpy(), keys[:, at[0]]
            if (own == own[0]).all():
                continue
            before = np.array(part["sketches"].to_pylist(), np.int64)[:, :band]
            said = [x for b in part.select(["text"]).to_batches() for _, t in chunks(iter([b])) for x in _each(t)]
            n = np.array([len(x) for x in said])
            for x in range(len(at) - 1):
                y = np.arange(x + 1, len(at))
                y = y[(own[y] != own[x]) & ((i == k) | (block[y] != block[x])) & (np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]) - 1e-6)]
                for z in y[(before[y] != before[x]).all(axis=1)].tolist():  # others meet in the group of an earlier band
                    if own[z] != own[x] and similarity(said[z], said[x], threshold) >= threshold:
                        found.append((int(ids[z]), int(ids[x])))
                        own[own == own[z]] = own[x]
        return pa.table({"id": pa.array([u for u, _ in found], pa.int64()), "leader": pa.array([v for _, v in found], pa.int64())})

    bucket = F.pmod(F.xxhash64("band", "sketch", "i", "k"), F.lit(buckets))
    return written(dealt.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(meet, "id long, leader long"), "across")


def _each(texts: Texts) -> list[np.ndarray]:
    """Labels of each text."""
    label, doc = labels(Words(texts, NON_SPACE))
    return np.split(label, np.searchsorted(doc, np.arange(1, texts.n)))


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, leader: links that join the near copies of each class, by the smallest doc_id of each text. With copies: id, leader of equal texts."""
    # the lists of ids grow with the documents: they are joined by shuffle at every size
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    same = docs.select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n"))
    # written, so the join reads shuffles of its own and Spark splits the rows of a text with very many copies
    firsts = written(same.groupBy("h", "n").agg(F.min("doc_id").alias("leader"), F.count("*").alias("c")).where("c > 1"), "firsts")
    copies = written(same.join(firsts.hint("merge"), ["h", "n"]).where("doc_id != leader").select(F.col("doc_id").alias("id"), "leader"), "copies")
    sketched = written(_sketched(docs).join(copies.select("id").distinct().hint("merge"), "id", "left_anti").dropDuplicates(["id"]), "sketches")
    pairs = written(_pairs(sketched), "pairs")
    needed = pairs.select(F.explode(F.array("id", "leader")).alias("doc_id")).distinct()
    texts = docs.join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    named = components(_verified(pairs, written(texts, "texts"), threshold))
    found = named.select("id", F.col("class").alias("leader"))
    across = _across(sketched, named, docs, threshold)
    if across is not None:
        found = found.unionByName(across)
    # copies of a text without words are no near copies: each stays alone
    copies = copies.join(sketched.select(F.col("id").alias("leader")), "leader", "left_semi").select("id", "leader")
    return found.unionByName(copies)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, class_id, n_in_class, kept (the first of its class)."""
    named = components(links(docs, threshold))
    out = docs.select("doc_id").join(named, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
    sizes = named.groupBy("class").agg((F.count("*") + 1).alias("n"))
    out = out.join(sizes, F.col("class_id") == F.col("class"), "left")
    return out.select("doc_id", "class_id", F.coalesce("n", F.lit(1)).cast("long").alias("n_in_class"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class; columns unchanged."""
    later = components(links(docs, threshold)).select(F.col("id").alias("doc_id"))
    return docs.join(later.hint("merge"), "doc_id", "left_anti").select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
