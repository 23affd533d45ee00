"""Substring dedup over super-k-mers.

A window is `WINDOW` consecutive words of one document (split at white space, unchanged). Its
minimiser is the leftmost smallest of the hashes of the runs of `MINI` words in it. Consecutive
windows with one minimiser are a super-k-mer: their words travel as one packed string to the bucket
of the minimiser. There the windows of all strings are sorted, and each finds the smallest document
that it starts in. Words under a window that also starts in a smaller document are removed.

Before that, each slice of documents sorts its own windows: one that an earlier document of
the slice holds is decided at once and does not travel. Strings travel compressed, those of `HELD_BYTES` for one
bucket together, and of equal ones with widely shared minimisers only that of the smallest document does. So of a passage that very many documents share, a
bucket gets one string for each `HELD_BYTES`, not one for each document; and where the input is large, those strings
are first combined in `salts` parts, and what each part leaves is combined again. Minimisers that very many documents share would make hot buckets, so they come last in the order
of hashes: a window takes one only if all its candidates are such, and then lies within what the documents share. Which ones,
a sample of slices says; any choice gives the same result. The number of buckets follows the size of the input, so that a bucket is about `BUCKET_BYTES`.

Windows are compared by 64-bit hashes, and equal ones once more by a second, independent hash of their words. Both are of
the words alone: what white space stands between them does not matter.

Defined results: null and short texts have no windows and lose nothing; a null doc_id is larger
than all others, and rows of one doc_id never remove each other's words; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from leafgate.llm.tables import written
from leafgate.llm.textarrays import NON_SPACE, Texts, U, Words, chunks, covered, mix, powers, ragged, sliding_argmin, strings

WINDOW, MINI = 13, 3
PROOF_MULT = 0xA0761D6478BD642F
BUCKET_BYTES = 16 << 20
HELD_BYTES = 48 << 20
PART_BYTES = 8 << 20
SLICE = 1 << 20
PRESS = 5
#: So many shared minimisers at most come last; one slice of SAMPLED looks for those in more than one of RARE documents.
HOT, SAMPLED, RARE = 30_000, 8, 32
LAST = (1 << 63) - 1  # stands for a null doc_id
PARTS = "bucket int, doc_id long, twin long, data binary"
DECIDED = "doc_id long, twin long, data binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(total: float, size: int = BUCKET_BYTES) -> int:
    return max(8, int(total / size) + 1)


#: Of a table of packed strings: which stay, and rows (doc_id, twin, data) of what the others have lost to them.
Combine = Callable[[pa.Table], tuple[np.ndarray, Iterator[tuple]]]


class Packer:
    """Rows on their way to buckets, held until they are worth compressing together."""

    def __init__(self, combine: Combine | None = None, hot: int = 0) -> None:
        self.held: dict[int, list[pa.RecordBatch]] = {}
        self.size = 0
        self.combine, self.hot = combine, hot  # equal strings are combined in buckets from hot on

    def add(self, bucket: np.ndarray, columns: dict[str, np.ndarray | pa.Array]) -> None:
        """bucket ascends."""
        batch = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], list(columns))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            self.held.setdefault(int(bucket[i]), []).append(batch.slice(i, j - i))
        self.size += batch.nbytes

    def rows(self) -> Iterator[tuple]:
        for bucket, batches in self.held.items():
            table = pa.Table.from_batches(batches).combine_chunks()
            if self.combine and bucket >= self.hot:
                stay, lost = self.combine(table)
                for r in lost:
                    yield None, *r
                table = table.take(pa.array(stay)) if len(stay) < table.num_rows else table
            yield bucket, None, None, packed(table)
        self.held, self.size = {}, 0


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return zstandard.ZstdCompressor(level=PRESS).compress(sink.getvalue())


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


def twin_of() -> Column:
    """Tells rows of one doc_id apart, by 64 bits; equal rows have one."""
    return F.xxhash64("doc_id", "text")


def least_owner(hashes: np.ndarray, owner: np.ndarray, proof: np.ndarray) -> np.ndarray:
    """For each window: the smallest owner of an equal one. proof: rows of further hashes that equal windows share."""
    order = np.lexsort((owner, hashes))
    new, split = _breaks(hashes[order], proof[:, order])
    if split:  # different windows of one hash: those that the proof tells apart must not lie between equal ones
        order = np.lexsort((owner, *proof, hashes))
        new, _ = _breaks(hashes[order], proof[:, order])
    at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(owner), owner.dtype)
    out[order] = owner[order][at]
    return out


def _breaks(hashes: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, bool]:
    """Where other windows begin, and whether any of those have the hash of the one before."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    split = ~new
    split[1:] &= (proof[:, 1:] != proof[:, :-1]).any(axis=0)
    return new | split, bool(split.any())


def _proof(words: Words, at: np.ndarray) -> np.ndarray:
    """A second hash of the words of each window."""
    own = mix(words.hash ^ U(PROOF_MULT))
    p = powers(PROOF_MULT, WINDOW)
    out = np.zeros(len(at), U)
    for j in range(WINDOW):
        out += own[at + j] * p[j]
    return mix(out)[None]


def _decided(batch: pa.RecordBatch, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
    """doc ascends; at: window starts, counted from the document's first word."""
    ids, twins = batch.column("doc_id"), batch.column("twin")
    own, first = np.unique(doc, return_index=True)
    for d, places in zip(own, np.split(at.astype(np.int32), first[1:])):
        yield ids[int(d)].as_py(), twins[int(d)].as_py(), places.tobytes()


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "data": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], list(names))


def equal_strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a table of packed strings in the order of string, doc_id and place, and for each the first row of its string. Strings are compared byte by byte."""
    texts = binary_texts(table["text"])
    start, end = texts.offs[:-1], texts.offs[1:]
    order = np.lexsort((table["at"].to_numpy(), table["doc_id"].to_numpy(), end - start, texts.hashes(start, end)))
    h, size = texts.hashes(start, end)[order], (end - start)[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(head != order)
    text = table["text"]
    other = again[~pc.equal(text.take(pa.array(order[again])), text.take(pa.array(head[again]))).to_numpy()]
    head[other] = order[other]
    return order, head


def _combined(table: pa.Table) -> tuple[np.ndarray, Iterator[tuple]]:
    """Strings whose words a smaller document has among the same strings lose all their windows."""
    order, head = equal_strings(table)
    ids, twins, at, n = (table[c].to_numpy() for c in ("doc_id", "twin", "at", "n"))
    gone = ids[order] > ids[head]
    lost = np.sort(order[gone])
    row = np.repeat(lost, n[lost])
    return np.sort(order[~gone]), _by_document(ids[row], twins[row], ragged(at[lost].astype(np.int64), n[lost].astype(np.int64)))


def _by_document(ids: np.ndarray, twins: np.ndarray, where: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
    order = np.lexsort((where, twins, ids))
    ids, twins, where = ids[order], twins[order], where[order].astype(np.int32)
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])) + 1
    for i, t, places in zip(np.split(ids, cut), np.split(twins, cut), np.split(where, cut)):
        if len(i):
            yield (None if i[0] == LAST else int(i[0])), int(t[0]), places.tobytes()


class Shared:
    """Hashes of runs that very many documents share."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & U(0xFFFFF)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where shared ones are."""
        at = np.flatnonzero(self.maybe[values & U(0xFFFFF)])
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.hashes, values[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == values[at]]

    def last(self, values: np.ndarray) -> np.ndarray:
        """values, where those of shared runs are the largest."""
        at = self.places(values)
        if not len(at):
            return values
        out = values.copy()
        out[at] |= U(0xFFFFFFFF00000000)
        return out


def widely_shared(docs: DataFrame, runs_of: Callable[[Texts], np.ndarray]) -> Shared:
    """The HOT most frequent at most. runs_of: hashes of all runs of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (_, texts) in enumerate(chunks(batches, most=SLICE)):
            if i % SAMPLED == 0:
                own, n = np.unique(runs_of(texts), return_counts=True)
                often = n >= max(16, texts.n // RARE)
                yield pa.RecordBatch.from_arrays([pa.array(own[often].view(np.int64)), pa.array(n[often])], ["run", "n"])

    found = docs.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    return Shared(found.orderBy(F.desc("n"), "run").limit(HOT).toArrow()["run"].to_numpy().view(U))


def _runs(texts: Texts) -> np.ndarray:
    hashes, whole = Words(texts, NON_SPACE).windows(MINI)
    return hashes[whole]


def salted(bucket: np.ndarray, minimiser: np.ndarray, shared: Shared, buckets: int, salts: int) -> np.ndarray:
    """bucket, where strings of widely shared minimisers go to one of the `salts` parts of their bucket by task. See decided."""
    at = shared.places(minimiser)
    out = bucket.copy()
    out[at] = buckets + bucket[at] * salts + TaskContext.get().partitionId() % salts
    return out


def super_kmers(docs: DataFrame, buckets: int, salts: int = 1) -> DataFrame:
    """bucket set: packed strings; bucket null: windows of a document that are decided."""

    shared = docs.sparkSession.sparkContext.broadcast(widely_shared(docs, _runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_combined, buckets)
        for batch, texts in chunks(batches, most=SLICE):
            words = Words(texts, NON_SPACE)
            hashes, whole = words.windows(WINDOW)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            twins = batch.column("twin").to_numpy()
            owner = ids[words.doc[at]]
            lost = least_owner(hashes[at], owner, _proof(words, at)) < owner
            rows = [(None, *r) for r in _decided(batch, words.doc[at[lost]], at[lost] - words.first[words.doc[at[lost]]])]
            # of equal windows with one owner all travel; they are decided alike
            mini, _ = words.windows(MINI)
            anchor = sliding_argmin(shared.value.last(mini)[: len(mini) - MINI + 1], WINDOW - MINI + 1)
            open_ = at[~lost]
            a = anchor[open_]
            new = np.ones(len(open_), bool)
            new[1:] = (a[1:] != a[:-1]) | (open_[1:] != open_[:-1] + 1) | (words.doc[open_[1:]] != words.doc[open_[:-1]])
            begin = np.flatnonzero(new)
            run_length = np.diff(np.append(begin, len(open_)))
            first = open_[begin]
            last = first + run_length - 1 + WINDOW - 1
            bucket = salted((mini[a[begin]] % U(buckets)).astype(np.int64), mini[a[begin]], shared.value, buckets, salts)
            order = np.argsort(bucket, kind="stable")
            first, last = first[order], last[order]
            doc = words.doc[first]
            packer.add(bucket[order], {"doc_id": ids[doc], "twin": twins[doc], "at": (first - words.first[doc]).astype(np.int32), "n": run_length[order].astype(np.int32), "text": strings(texts.buf, words.start[first], words.end[last])})
            if packer.size > HELD_BYTES:
                rows += packer.rows()
            yield _rows(rows, ("bucket", "doc_id", "twin", "data"))
        yield _rows(list(packer.rows()), ("bucket", "doc_id", "twin", "data"))

    return docs.select("doc_id", twin_of().alias("twin"), "text").mapInArrow(run, PARTS)


def _resolve(group: pa.Table) -> pa.Table:
    """The windows of one bucket that a smaller document holds; what was decided before passes."""
    rows = []
    blobs = []
    for bucket, doc, twin, data in zip(*(group[c].to_pylist() for c in ("bucket", "doc_id", "twin", "data"))):
        if bucket is None or bucket < 0:
            rows.append((doc, twin, data))
        else:
            blobs.append(unpacked(data))
    parts = []
    for blob in blobs:  # one at a time: only hashes and places of all are held together
        texts = binary_texts(blob["text"])
        words = Words(texts, NON_SPACE)
        hashes, whole = words.windows(WINDOW)
        at = np.flatnonzero(whole)
        row = words.doc[at]
        parts.append((hashes[at], _proof(words, at), *(blob[c].to_numpy()[row] for c in ("doc_id", "twin")), blob["at"].to_numpy()[row] + (at - words.first[row])))
    if parts:
        hashes, proof, ids, twins, where = (np.concatenate(x, axis=-1) for x in zip(*parts))
        lost = least_owner(hashes, ids, proof) < ids
        rows += _by_document(ids[lost], twins[lost], where[lost])
    return pa.Table.from_batches([_rows(rows, ("doc_id", "twin", "data"))])


def binary_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Texts of a large_binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return Texts(buf[offs[0] : offs[-1]], offs - offs[0])


def salts_for(total: float) -> int:
    """So many parts of hot buckets that each gets strings of some hundred packs, whatever the size of the input."""
    return max(1, int(total / (100 * HELD_BYTES)))


def decided(parts: DataFrame, buckets: int, resolve: Callable[[pa.Table], pa.Table], combine: Combine, salts: int = 1) -> DataFrame:
    """doc_id, twin, data: what is decided, some rows for a document. parts: of super_kmers."""
    parts = parts.withColumn("bucket", F.coalesce("bucket", (-1 - F.pmod(F.col("twin"), F.lit(buckets))).cast("int")))
    if salts == 1:  # what each task has combined meets in its bucket
        return parts.withColumn("bucket", F.when(F.col("bucket") >= buckets, F.col("bucket") - buckets).otherwise(F.col("bucket"))).groupBy("bucket").applyInArrow(resolve, DECIDED)

    def once(group: pa.Table) -> pa.Table:
        """Resolves a bucket, or combines a part of a hot one."""
        bucket = group["bucket"][0].as_py()
        if bucket < buckets:
            done = resolve(group)
            return pa.table([pa.nulls(done.num_rows, pa.int32()), *done.columns], ["bucket", *done.column_names])
        table = pa.Table.from_batches([unpacked(x.as_py()) for x in group["data"]]).combine_chunks()
        stay, lost = combine(table)
        return pa.Table.from_batches([_rows([((bucket - buckets) // salts, None, None, packed(table.take(pa.array(stay)))), *((None, *r) for r in lost)], ("bucket", "doc_id", "twin", "data"))])

    first = written(parts.groupBy("bucket").applyInArrow(once, PARTS), "combined")
    rest = first.where("bucket is not null").groupBy("bucket").applyInArrow(resolve, DECIDED)
    return first.where("bucket is null").drop("bucket").unionByName(rest)


def applied(docs: DataFrame, marks: DataFrame, parts: int, apply: Callable[[Texts, list[list[bytes]]], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """What apply makes of each text and its decided windows. Texts travel compressed to the part of their document, of equal rows of a slice one with their number."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for batch, texts in chunks(batches, most=SLICE):
            part, twin = batch.column("part").to_numpy(), batch.column("twin").to_numpy()
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            order = np.lexsort((ids, twin, part))
            head = np.append(True, (ids[order][1:] != ids[order][:-1]) | (twin[order][1:] != twin[order][:-1]))
            times = np.diff(np.append(np.flatnonzero(head), len(order))).astype(np.int32)
            order = order[head]
            text = strings(texts.buf, texts.offs[:-1][order], texts.offs[1:][order])
            packer.add(part[order], {"doc_id": batch.column("doc_id").take(pa.array(order)), "twin": twin[order], "times": times, "text": text})
            if packer.size > HELD_BYTES:
                yield _rows([(r[0], r[3]) for r in packer.rows()], ("bucket", "data"))
        yield _rows([(r[0], r[3]) for r in packer.rows()], ("bucket", "data"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        marks: dict[tuple, list[bytes]] = {}
        for doc, twin, data in zip(*(right[c].to_pylist() for c in ("doc_id", "twin", "data"))):
            marks.setdefault((doc, twin), []).append(data)
        out = []
        for blob in left["data"]:
            batch = unpacked(blob.as_py())
            own = [marks.get(k, []) for k in zip(batch["doc_id"].to_pylist(), batch["twin"].to_pylist())]
            columns = {"doc_id": batch["doc_id"], **apply(binary_texts(batch["text"]), own)}
            every = pa.array(np.repeat(np.arange(batch.num_rows), batch["times"].to_numpy()))
            out.append(pa.RecordBatch.from_arrays([(columns[n] if n == "doc_id" else pa.array(columns[n])).take(every) for n in names], names))
        empty = [pa.array([], pa.string() if "string" in f else pa.int64()) for f in schema.split(", ")]
        return pa.Table.from_batches(out or [pa.RecordBatch.from_arrays(empty, names)])

    part = F.pmod(twin_of(), F.lit(parts)).cast("int")
    texts = docs.select("doc_id", twin_of().alias("twin"), part.alias("part"), "text").mapInArrow(run, "bucket int, data binary")
    marks = marks.withColumn("bucket", F.pmod("twin", F.lit(parts)).cast("int"))
    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(meet, schema)


def _kept(texts: Texts, marks: list[list[bytes]]) -> dict[str, np.ndarray | list]:
    words = Words(texts, NON_SPACE)
    n_removed, sha = np.zeros(texts.n, np.int64), []
    for i in range(texts.n):
        a, b = words.first[i], words.first[i + 1]
        keep = np.arange(a, b)
        if marks[i]:
            places = np.concatenate([np.frombuffer(x, np.int32) for x in marks[i]]).astype(np.int64)
            gone = covered(places, WINDOW, int(b - a))
            n_removed[i], keep = gone.sum(), keep[~gone]
        size = words.end[keep] - words.start[keep]
        out = np.full(int(size.sum()) + len(keep), 32, np.uint8)
        out[ragged(np.cumsum(size + 1) - size - 1, size)] = texts.buf[ragged(words.start[keep], size)]
        sha.append(hashlib.sha256(out[:-1].tobytes()).hexdigest())
    return {"n_words": words.count.astype(np.int64), "n_removed": n_removed, "kept_sha256": sha}


def substring_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    total = text_bytes(docs)
    buckets, salts = buckets_for(3.2 * total), salts or salts_for(total)  # so many bytes travel for one of text
    return applied(docs, decided(super_kmers(docs, buckets, salts), buckets, _resolve, _combined, salts), buckets_for(total, PART_BYTES), _kept, RESULT)
