"""Texts of an Arrow batch as flat numpy arrays: words, rolling hashes, windows.

All helpers work on whole batches at once, so that a task never loops over words in Python.
Hashes are 64-bit polynomial prefix hashes over a random byte table, finished by a mixer; they
are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULT = 0x9E3779B97F4A7C15 | 1
WORD_MULT = 0xD6E8FEB86659FD93 | 1
CHUNK_BYTES = 1 << 20
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
FOLDED = _BYTES[_FOLD]
PLAIN = _BYTES

#: Bytes that belong to a word, by definition of word.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True  # capitals count as the letters that they fold to
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        run = np.full(max(n, CHUNK_BYTES + 4096), base, U)
        run[0] = 1
        _powers[base] = have = np.multiply.accumulate(run)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """Whole texts one after another. buf: their UTF-8 bytes; offs: where each begins, and the end."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        self.n = len(offs) - 1
        self._prefix: dict[int, np.ndarray] = {}

    def prefix(self, table: np.ndarray) -> np.ndarray:
        """prefix[i]: hash sum of the bytes before i."""
        key = id(table)
        if key not in self._prefix:
            out = np.zeros(len(self.buf) + 1, U)
            np.cumsum(table[self.buf] * powers(MULT, len(self.buf)), out=out[1:])
            self._prefix[key] = out
        return self._prefix[key]

    def hashes(self, start: np.ndarray, end: np.ndarray, table: np.ndarray = PLAIN) -> np.ndarray:
        """Of the byte ranges start:end."""
        p = self.prefix(table)
        inverse = powers(pow(MULT, -1, 1 << 64), len(self.buf) + 1)
        return mix((p[end] - p[start]) * inverse[start])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes for which the 256-entry table holds, within texts."""
        w = inside[self.buf]
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = self.offs[:-1]
        edge = edge[edge < len(w)]
        before = np.empty(len(w), bool)
        before[0] = False
        before[1:] = w[:-1]
        before[edge] = False
        after = np.empty(len(w), bool)
        after[-1] = False
        after[:-1] = w[1:]
        after[edge[edge > 0] - 1] = False
        return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position; pos ascends."""
        counts = np.diff(np.searchsorted(pos, self.offs))
        return np.repeat(np.arange(self.n), counts)


class Words:
    """The words of texts: byte range, hash and text index of each; first[d]:first[d+1] are text d's."""

    def __init__(self, texts: Texts, inside: np.ndarray, table: np.ndarray = PLAIN):
        self.texts = texts
        self.start, self.end = texts.runs(inside)
        self.hash = texts.hashes(self.start, self.end, table)
        self.first = np.searchsorted(self.start, texts.offs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of k consecutive words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, U), np.zeros(n, bool)
        p = powers(WORD_MULT, k)
        out = np.zeros(n, U)
        m = n - k + 1
        for j in range(k):
            out[:m] += self.hash[j : j + m] * p[j]
        whole = np.zeros(n, bool)
        whole[:m] = self.doc[:m] == self.doc[k - 1 :]
        return mix(out), whole


def texts_of(column: pa.Array) -> Texts:
    """Nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Texts(buf[offs[0] : offs[-1]], offs - offs[0])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of whole rows with about so many bytes of text; a longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(whole.offs, whole.offs[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            o = whole.offs[at : to + 1]
            yield batch.slice(at, to - at), Texts(whole.buf[o[0] : o[-1]], o - o[0])
            at = to


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of w consecutive values (by their upper 32 bits), from each position on."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (values & U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=U)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: n], key[w - span : w - span + n])
    return (key[:n] & U(0xFFFFFFFF)).astype(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (length[0] of them), then start[1], .."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(length) - length
    full = length > 0
    s, a, ln = start[full], at[full], length[full]
    out[a[0]] = s[0]
    out[a[1:]] = s[1:] - (s[:-1] + ln[:-1] - 1)
    return np.cumsum(out)


def covered(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether each of n places lies in first[i]:first[i]+length for some i."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def sums(at: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Binary Arrow array of the byte ranges start:end."""
    length = end - start
    offs = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offs[1:])
    data = buf[ragged(start, length)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
