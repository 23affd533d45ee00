"""Benchmark decontamination by winnowing.

Words are the runs of letters, digits and non-ASCII characters after A-Z is lower-cased. Every
run of k words has a hash; of each w consecutive ones the leftmost smallest is a fingerprint, so
two texts that share k + w - 1 words share a fingerprint there. Fingerprints of the documents are
looked up among those of the benchmark, and each hit is extended to the windows of k + w - 1
words around it, which are compared themselves. An item with fewer words is one window.

Defined results: a null or wordless text has no words and no hits; a wordless item occurs nowhere;
a null item_id reads as "null"; repeated items with one item_id count once; repeated documents give
repeated rows; extra columns are ignored (query) or passed on (stage).

The benchmark is read in blocks of about `block_windows` windows (16 bytes each), dealt by the hash of a window's fingerprint, so an
item of any length is split. One block at a time is sent to all executors, so what is sent has a fixed bound; a
larger benchmark takes more passes, each of which is written before the next begins.

Windows that many items share, as those of a template, are there once, with a number for the set of their items; windows of one set share it. A document's hits are
kept as runs of covered words, and its sets are made distinct before they become items, so neither grows with occurrences times items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafgate.llm.tables import sifted, written
from leafgate.llm.textarrays import ALNUM, FOLDED, U, Words, chunks, mix, sliding_argmin

K, W = 5, 6
BLOCK_WINDOWS = 2_000_000
WINDOWS = "size int, hash long, print long, item_id string"
FOUND = "doc_id long, twin long, n_words long, starts array<int>, ends array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _fingerprints(words: Words, k: int, w: int) -> np.ndarray:
    """Word positions of the fingerprints."""
    n, t = len(words.doc), k + w - 1
    if n < t:
        return np.zeros(0, np.int64)
    at = sliding_argmin(words.windows(k)[0][: n - k + 1], w)
    return np.unique(at[words.doc[: n - t + 1] == words.doc[t - 1 :]])


def benchmark_windows(benchmark: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Windows of all items, each with its fingerprint (null where an item is one short window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = k + w - 1
        for batch, texts in chunks(batches):
            words = Words(texts, ALNUM, FOLDED)
            names = np.array([str(x) if x is not None else "null" for x in batch.column("item_id").to_pylist()], object)
            full, whole = words.windows(t)
            at = np.flatnonzero(whole)
            grams = words.windows(k)[0]
            own = grams[sliding_argmin(grams[: len(grams) - k + 1], w)[at]] if len(at) else full[:0]
            parts = [(np.full(len(at), t), full[at], pa.array(own.view(np.int64)), names[words.doc[at]])]
            for size in range(1, t):
                short = np.flatnonzero(words.count == size)
                if len(short):
                    parts.append((np.full(len(short), size), words.windows(size)[0][words.first[short]], pa.nulls(len(short), pa.int64()), names[short]))
            for size, hashes, prints, items in parts:
                yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(hashes.view(np.int64)), prints, pa.array(items, pa.string())], ["size", "hash", "print", "item_id"])

    return benchmark.select("item_id", "text").mapInArrow(run, WINDOWS).distinct()


class Block:
    """A bounded part of the benchmark's windows, as sorted arrays."""

    def __init__(self, rows: pa.Table, k: int, w: int):
        self.k, self.w = k, w
        size, hashes = rows["size"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        self.prints = np.unique(rows["print"].combine_chunks().drop_null().to_numpy().view(np.uint64))
        self.names, codes = np.unique(np.array(rows["item_id"].to_pylist(), object).astype(str), return_inverse=True)
        self.by_size = {}  # the windows of a size, and the set of items of each
        at, n, items, n_sets, n_rows = [], [], [], 0, 0
        for s in np.unique(size):
            own = size == s
            order = np.lexsort((codes[own], hashes[own]))
            window, item = hashes[own][order], codes[own][order]
            first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            times = np.diff(np.append(first, len(window)))
            name = mix(np.add.reduceat(mix(item.astype(U) + U(1)), first) ^ mix(times.astype(U)))  # a set is known by the hashes of its items
            _, one, which = np.unique(name, return_index=True, return_inverse=True)
            self.by_size[int(s)] = (window[first], which + n_sets)
            at.append(first[one] + n_rows)
            n.append(times[one])
            items.append(item)
            n_sets, n_rows = n_sets + len(one), n_rows + len(item)
        none = np.zeros(0, np.int64)
        self.set_at, self.set_n, self.set_items = (np.concatenate([none, *x]) for x in (at, n, items))

    def _look_up(self, size: int, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of word positions whose windows occur in items: position and set of items."""
        table, sets = self.by_size[size]
        near = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        hit = table[near] == hashes
        return at[hit], sets[near[hit]]

    def items(self, doc: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and item of all distinct pairs of them, in order."""
        pair = np.unique(doc.astype(np.int64) << 32 | sets)
        doc, sets = pair >> 32, pair & 0xFFFFFFFF
        n = self.set_n[sets]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(np.repeat(doc, n) << 32 | self.set_items[np.repeat(self.set_at[sets], n) + step])
        return pair >> 32, pair & 0xFFFFFFFF

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and set of items of all occurrences of windows."""
        t = self.k + self.w - 1
        found = []
        for size in self.by_size:
            if size == t:
                grams = words.windows(self.k)[0]
                at = _fingerprints(words, self.k, self.w)
                near = np.searchsorted(self.prints, grams[at])
                at = at[(near < len(self.prints)) & (self.prints[np.minimum(near, len(self.prints) - 1)] == grams[at])] if len(self.prints) else at[:0]
                at = np.unique((at[:, None] - np.arange(self.w)).ravel())
                hashes, whole = words.windows(t)
                at = at[at >= 0]
                at = at[whole[at]]
            else:
                hashes, whole = words.windows(size)
                at = np.flatnonzero(whole)
            where, sets = self._look_up(size, at, hashes[at])
            found.append((where, np.full(len(where), size), sets))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))


def _blocks(benchmark: DataFrame, k: int, w: int, most: int) -> Iterator[tuple[Block, bool]]:
    """Blocks of about `most` windows, and whether there are several. Windows of one fingerprint go to one block."""
    rows = benchmark_windows(benchmark, k, w)
    n = rows.count()
    if n <= most:
        yield Block(rows.toArrow(), k, w), False
        return
    parts = -(-2 * n // most)
    rows = written(rows, "windows").withColumn("part", F.pmod(F.xxhash64(F.coalesce("print", "hash")), F.lit(parts)))
    for i in range(parts):
        yield Block(rows.where(F.col("part") == i).toArrow(), k, w), True


def _runs(low: np.ndarray, high: np.ndarray, n: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of positions below n that the ranges cover; runs end at cuts."""
    step = np.bincount(low, minlength=n + 1)[: n + 1] - np.bincount(high, minlength=n + 1)[: n + 1]
    inside = np.concatenate([[False], np.cumsum(step[:n]) > 0, [False]])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = ends[cuts] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def occurrences(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch, texts in chunks(batches):
            words = Words(texts, ALNUM, FOLDED)
            start, size, sets = block.find(words)
            low, high = _runs(start, start + size, len(words.doc), words.first)
            owner, item = block.items(words.doc[start] if len(start) else start, sets)
            run_of = words.doc[low] if len(low) else low
            base = words.first[run_of] if len(low) else low
            every = np.arange(texts.n + 1)
            offs, item_offs = (pa.array(np.searchsorted(x, every).astype(np.int32)) for x in (run_of, owner))
            names = pa.array(block.names[item] if len(item) else [], pa.string())
            lists = [*(pa.ListArray.from_arrays(offs, pa.array(x - base, pa.int32())) for x in (low, high)), pa.ListArray.from_arrays(item_offs, names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array(words.count, pa.int64()), *lists], ["doc_id", "twin", "n_words", "starts", "ends", "items"])

    return docs.select("doc_id", F.xxhash64("text").alias("twin"), "text").mapInArrow(run, FOUND)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n_words = batch.column("n_words").to_numpy()
        n_hit, n_items, sha = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64), [none] * len(n_words)
        lengths = np.diff(batch.column("starts").offsets.to_numpy())
        for i in np.flatnonzero(lengths):
            low, high = _runs(*(batch.column(c)[i].values.to_numpy() for c in ("starts", "ends")), int(n_words[i]), np.zeros(0, np.int64))
            n_hit[i] = (high - low).sum()
            items = sorted(set(batch.column("items")[i].as_py()))
            n_items[i], sha[i] = len(items), hashlib.sha256(",".join(items).encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit), pa.array(n_items), pa.array(sha), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    parts = [written(occurrences(docs, b), "found") if several else occurrences(docs, b) for b, several in _blocks(benchmark, k, w, block_windows)]
    if len(parts) > 1:
        every = reduce(DataFrame.unionAll, parts).groupBy("doc_id", "twin", "n_words")
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
        every = every.agg(*lists, (F.count("*") / len(parts)).cast("int").alias("copies"))
        parts = [every.select("doc_id", "twin", "n_words", "starts", "ends", "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")]
    return parts[0].mapInArrow(_finish, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without those in which a window of an item occurs; columns and other rows unchanged."""
    for block, several in _blocks(benchmark, k, w, block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches):
                words = Words(texts, ALNUM, FOLDED)
                start = shared.value.find(words)[0]
                clean = np.ones(texts.n, bool)
                clean[words.doc[start] if len(start) else start] = False
                yield batch.filter(pa.array(clean))

        docs = sifted(docs, run)
        docs = written(docs, "clean") if several else docs
    return docs
