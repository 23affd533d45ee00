"""Substring dedup by blockwise suffix sorting with a difference cover.

Of every string of `LENGTH` bytes only the first start counts (smallest doc_id, then smallest start);
the bytes under all other starts are removed.

Suffixes are dealt to Spark's tasks by content: the leftmost smallest of the hashes of the `GRAM`-byte
strings in the first LENGTH bytes of a suffix, its anchor, names its bucket, so equal ones meet (strings that very many documents share come last). Neighbouring suffixes
with one anchor travel as one piece of text. Pieces whose anchor occurs once in a bucket are done. Of the others, in parts of `BLOCK_BYTES`,
the suffix array is built blockwise. First the sample is ranked: the positions whose distance from their piece's anchor, modulo `PERIOD`,
lies in `COVER`, a difference cover, so for any two suffixes there is an offset below PERIOD at which both are in the sample.
Ranks follow the order of the text from there to the piece's end, by doubling. Then the suffixes are dealt to blocks by their leading eight bytes, with
splitters from a sample of them, and one block at a time is sorted: by the leading bytes, and what ties by the ranks at the
offset that both share. Suffixes that agree in LENGTH bytes are neighbours in this order; neighbours are compared byte by byte, so nothing rests on hashes.
Memory beyond the part's text is a rank for three sevenths of it, and one block.

Each slice of documents first compares its own pieces: a copy of an earlier piece is decided at once and does not travel. Pieces of widely shared anchors are
combined further on their way (see substring).

Defined results: null texts are empty; texts below LENGTH bytes lose nothing; a null doc_id is larger
than all others; rows of one doc_id count as one document; repeated rows give repeated rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafgate.llm.substring import HELD_BYTES, LAST, PART_BYTES, PARTS, Packer, _rows, applied, binary_texts, buckets_for, decided, equal_strings, salted, salts_for, text_bytes, twin_of, unpacked, widely_shared
from leafgate.llm.textarrays import MULT, PLAIN, Texts, U, chunks, mix, powers, ragged, sliding_argmin, strings

LENGTH, GRAM = 100, 16
PERIOD, COVER = 7, (0, 1, 3)
SLICE = 1 << 20
BUCKET_BYTES = 12 << 20
BLOCK_BYTES = 3 << 19
#: Suffixes of one block, about; a splitter is the middle of so many sampled ones.
SORTED, SPLIT_SAMPLE = 1 << 18, 64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf), strides=(1,))


def _hashes(texts: Texts, size: int) -> np.ndarray:
    """Hash of the string of so many bytes from each place on."""
    p = texts.prefix(PLAIN)
    n = max(0, len(texts.buf) - size + 1)
    return mix((p[size:] - p[:n]) * powers(pow(MULT, -1, 1 << 64), len(texts.buf) + 1)[:n])


def _ranges(at: np.ndarray, end: np.ndarray) -> bytes:
    """Ranges of suffix starts, as pairs."""
    return np.stack([at, end], axis=1).astype(np.int32).tobytes()


def _by_document(ids: np.ndarray, twins: np.ndarray, at: np.ndarray, end: np.ndarray) -> Iterator[tuple[int | None, int, bytes]]:
    order = np.lexsort((at, twins, ids))
    ids, twins, at, end = ids[order], twins[order], at[order], end[order]
    cut = np.flatnonzero((ids[1:] != ids[:-1]) | (twins[1:] != twins[:-1])) + 1
    for i, t, a, e in zip(np.split(ids, cut), np.split(twins, cut), np.split(at, cut), np.split(end, cut)):
        if len(i):
            yield (None if i[0] == LAST else int(i[0])), int(t[0]), _ranges(a, e)


def _combined(table: pa.Table) -> tuple[np.ndarray, Iterator[tuple]]:
    """Pieces of which an equal one starts earlier lose all their suffixes. Repeated rows of one document start at one place."""
    order, head = equal_strings(table)
    ids, twins, at = (table[c].to_numpy() for c in ("doc_id", "twin", "at"))
    gone = (ids[order] != ids[head]) | (at[order] != at[head])
    lost = order[gone]
    n = np.diff(binary_texts(table["text"]).offs)[lost] - LENGTH + 1
    return np.sort(order[~gone]), _by_document(ids[lost], twins[lost], at[lost].astype(np.int64), at[lost] + n)


def pieces(docs: DataFrame, buckets: int, salts: int = 1) -> DataFrame:
    """bucket set: pieces of text, each with its suffix starts; bucket null: starts of a document that are decided."""

    common = docs.sparkSession.sparkContext.broadcast(widely_shared(docs, lambda texts: _hashes(texts, GRAM)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_combined, buckets)
        for batch, texts in chunks(batches, most=SLICE):
            size = np.diff(texts.offs)
            starts = np.maximum(size - LENGTH + 1, 0)
            if not starts.any():
                continue
            at = ragged(texts.offs[:-1], starts)
            doc = np.repeat(np.arange(texts.n), starts)
            gram = _hashes(texts, GRAM)
            anchor = sliding_argmin(common.value.last(gram), LENGTH - GRAM + 1)[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(at)))
            first, anchor, doc = at[begin], anchor[begin], doc[begin]
            last = first + count + LENGTH - 1
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()[doc]
            twins = batch.column("twin").to_numpy()[doc]
            place = first - texts.offs[doc]
            whole = texts.hashes(first, last)
            order = np.lexsort((place, ids, last - first, whole))
            same = np.zeros(len(order), bool)
            same[1:] = (whole[order][1:] == whole[order][:-1]) & ((last - first)[order][1:] == (last - first)[order][:-1])
            lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            copy = np.zeros(len(order), bool)
            copy[order] = (ids[order] != ids[lead]) | (place[order] != place[lead])
            gone = np.flatnonzero(copy)  # in the order of the text, so neighbours make one range
            new = np.append(True, (doc[gone][1:] != doc[gone][:-1]) | (place[gone][1:] != (place + count)[gone][:-1]))[: len(gone)]
            head = gone[new]
            tail = gone[np.append(np.flatnonzero(new)[1:], len(gone))[: len(head)] - 1]
            rows = [(None, *r) for r in _by_document(ids[head], twins[head], place[head], (place + count)[tail])]
            bucket = salted((gram[anchor] % U(buckets)).astype(np.int64), gram[anchor], common.value, buckets, salts)
            own = np.flatnonzero(~copy)
            own = own[np.argsort(bucket[own], kind="stable")]
            packer.add(bucket[own], {
                "doc_id": ids[own], "twin": twins[own], "at": place[own].astype(np.int32), "anchor": (anchor[own] - first[own]).astype(np.int32),
                "text": strings(texts.buf, first[own], last[own]),
            })
            if packer.size > HELD_BYTES:
                rows += packer.rows()
            yield _rows(rows, ("bucket", "doc_id", "twin", "data"))
        yield _rows(list(packer.rows()), ("bucket", "doc_id", "twin", "data"))

    return docs.select("doc_id", twin_of().alias("twin"), "text").mapInArrow(run, PARTS)


IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Of two residues, the smallest offset that brings both into the cover.
OFFSET = np.array([[next(d for d in range(PERIOD) if IN_COVER[(r + d) % PERIOD] and IN_COVER[(s + d) % PERIOD]) for s in range(PERIOD)] for r in range(PERIOD)])


def _ties(head: np.ndarray) -> np.ndarray:
    """Places in groups of more than one. head: of each place, the first of its group."""
    same = np.zeros(len(head) + 1, bool)
    same[1:-1] = head[1:] == head[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Of each place, the first of its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Sample:
    """The difference cover's sample of pieces of text, and its ranks: the order of the text from there to its piece's end."""

    def __init__(self, texts: Texts, anchor: np.ndarray):
        n, size = len(texts.buf), np.diff(texts.offs)
        self.residue = ((np.arange(n) - np.repeat(texts.offs[:-1] + anchor, size)) % PERIOD).astype(np.int8)
        at = np.flatnonzero(IN_COVER[self.residue])
        end = np.repeat(texts.offs[1:], size)[at]
        self.place = np.full(n, -1, np.int32)
        self.place[at] = np.arange(len(at))
        left = np.minimum(end - at, 8)
        keys = [_eight(np.append(texts.buf, np.zeros(8, np.uint8)))[at].byteswap() & (U(0xFFFFFFFFFFFFFFFF) << ((8 - left) * 8).astype(U))]
        if not texts.buf.all():  # zero bytes in the text: what lies beyond an end comes before them
            keys.insert(0, left)
        order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
        head = _heads(*(k[order] for k in keys))
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = head
        seen, step, tied = 8, PERIOD, _ties(head)
        while len(tied) and seen < size.max():
            own = order[tied]
            to = at[own] + step
            after = np.where(to < end[own], self.rank[self.place[np.minimum(to, n - 1)]] + 1, 0)
            both = self.rank[own] << 32 | after
            again = np.argsort(both)
            own = own[again]
            order[tied] = own
            head = tied[_heads(both[again])]
            self.rank[own] = head
            tied = tied[_ties(head)]
            seen, step = seen + step, (seen + step) // PERIOD * PERIOD

    def of(self, at: np.ndarray, offset: np.ndarray | int) -> np.ndarray:
        """Ranks of the sampled places so far behind each."""
        return self.rank[self.place[at + offset]]


def suffix_blocks(texts: Texts, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffix array of pieces of text, a block at a time: starts of all suffixes of LENGTH bytes or more within them, in order,
    and whether each agrees with the one before in LENGTH bytes. anchor: of each piece, the place from which residues are counted."""
    at = ragged(texts.offs[:-1], np.maximum(np.diff(texts.offs) - LENGTH + 1, 0))
    if not len(at):
        return
    sample = Sample(texts, anchor)
    word = _eight(texts.buf)
    key = word[at].byteswap()
    blocks = -(-len(at) // SORTED)
    middle = np.sort(key[:: max(1, len(at) // (blocks * SPLIT_SAMPLE))])
    splitters = middle[np.arange(1, blocks) * len(middle) // blocks]
    block = np.searchsorted(splitters, key, "right")
    dealt = np.argsort(block, kind="stable")
    for own in np.split(dealt, np.searchsorted(block[dealt], np.arange(1, blocks))):
        if len(own):
            yield _block(at[own], key[own], sample, word)


def _block(at: np.ndarray, key: np.ndarray, sample: Sample, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = _heads(key)
    tied = _ties(group)
    rank = np.arange(len(at)) - len(at)  # of its own residue; those without ties differ from all
    if len(tied):
        own, g = at[tied], group[tied]
        r = sample.residue[own]
        by_own = sample.of(own, OFFSET[r, r])
        again = np.argsort(g << 32 | by_own)
        own, r, by_own = own[again], r[again], by_own[again]
        # groups of several residues are split by the next eight bytes, and what is left of several by merging the lists of its residues
        mine = _several(g, r)
        if len(mine):
            deeper = word[own[mine] + 8].byteswap()
            by = np.argsort(deeper)
            level = np.empty(len(by), np.int64)
            level[by] = _heads(deeper[by])
            by = np.argsort(g[mine] << 32 | level, kind="stable")  # stable: residues' lists stay in order
            own[mine], r[mine], by_own[mine] = (x[mine][by] for x in (own, r, by_own))
            part = _heads(g[mine], level[by])
            left = _several(part, r[mine])
            mine, part = mine[left], part[left]
            if len(mine):
                own[mine], r[mine], by_own[mine] = (x[mine][_merged(own[mine], r[mine], part, sample)] for x in (own, r, by_own))
        at[tied] = own
        rank[tied] = by_own * PERIOD + r
    same = np.zeros(len(at), bool)
    same[1:] = rank[1:] == rank[:-1]
    near = np.flatnonzero((key[1:] == key[:-1]) & ~same[1:])  # agree in eight bytes, not to their ends
    for step in (*range(8, LENGTH - 8, 8), LENGTH - 8):
        near = near[word[at[near] + step] == word[at[near + 1] + step]]
    same[near + 1] = True
    return at, same


def _several(group: np.ndarray, residue: np.ndarray) -> np.ndarray:
    """Places in groups (ascending) of several residues."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(group)]
    if not len(first):
        return first
    size = np.diff(np.append(first, len(group)))
    return np.flatnonzero(np.repeat(np.maximum.reduceat(residue, first) != np.minimum.reduceat(residue, first), size))


def _merged(at: np.ndarray, residue: np.ndarray, group: np.ndarray, sample: Sample) -> np.ndarray:
    """The order of suffixes of several residues, which agree within their group in eight bytes or more and are in order within group and residue."""
    lists = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    place = np.empty(len(at), np.int64)
    for r, mine in enumerate(lists):
        before = np.arange(len(mine))
        for s, other in enumerate(lists):
            if s != r and len(mine) and len(other):
                a, b = (group[x].astype(np.int64) << 32 | sample.of(at[x], OFFSET[r, s]) for x in (mine, other))
                before = before + np.searchsorted(b, a, "left" if r < s else "right")
        place[mine] = before
    out = np.empty(len(at), np.int64)
    out[place] = np.arange(len(at))
    return out


def first_equal(texts: Texts, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of suffixes of which an equal one (in LENGTH bytes) starts before, and the first of those."""
    later, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, same in suffix_blocks(texts, anchor):
        head = np.flatnonzero(~same)
        first = np.repeat(np.minimum.reduceat(at, head), np.diff(np.append(head, len(at))))
        later.append(at[at > first])
        firsts.append(first[at > first])
    at, first = np.concatenate(later), np.concatenate(firsts)
    order = np.argsort(at)
    return at[order], first[order]


def _resolve(group: pa.Table) -> pa.Table:
    """The suffixes of one bucket that start earlier; what was decided before passes."""
    rows, blobs = [], []
    for bucket, doc, twin, data in zip(*(group[c].to_pylist() for c in ("bucket", "doc_id", "twin", "data"))):
        if bucket < 0:
            rows.append((doc, twin, data))
        else:
            blobs.append(unpacked(data))
    names = []
    for blob in blobs:
        texts = binary_texts(blob["text"])
        word, spot = _eight(texts.buf), texts.offs[:-1] + blob["anchor"].to_numpy()
        name = np.zeros(len(spot), U)
        for i in range(0, GRAM, 8):
            name = mix(name ^ word[spot + i])
        names.append(name)
    if names:
        own, which, times = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(n) for n in names])
        shared = [np.flatnonzero(times[w] > 1) for w in np.split(which, ends[:-1])]
        name = np.concatenate([n[k] for n, k in zip(names, shared)])
        table = pa.Table.from_batches([b.take(pa.array(k)) for b, k in zip(blobs, shared)])
        order = np.argsort(name, kind="stable")
        size = np.cumsum(np.diff(binary_texts(table["text"]).offs)[order])
        new = np.flatnonzero(np.diff(name[order])) + 1  # an anchor's pieces stay in one block
        cut = [int(new[i]) for i in np.flatnonzero(np.diff(size[new - 1] // BLOCK_BYTES, prepend=0))] if len(new) else []
        for part in np.split(order, cut):
            if len(part):
                rows += _later(table.take(pa.array(part)).sort_by([("doc_id", "ascending"), ("at", "ascending")]))
    return pa.Table.from_batches([_rows(rows, ("doc_id", "twin", "data"))])


def _later(table: pa.Table) -> Iterator[tuple[int | None, int, bytes]]:
    """What starts earlier among pieces, which come in the order of their starts."""
    texts = binary_texts(table["text"])
    ids, twins, place = (table[c].to_numpy() for c in ("doc_id", "twin", "at"))
    at, first = first_equal(texts, table["anchor"].to_numpy())
    piece, lead = (np.searchsorted(texts.offs, x, "right") - 1 for x in (at, first))
    start, before = place[piece] + at - texts.offs[piece], place[lead] + first - texts.offs[lead]
    lost = np.flatnonzero((ids[piece] != ids[lead]) | (start != before))
    p, s = piece[lost], start[lost]
    new = np.ones(len(lost), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(lost))[: len(head)] - 1
    yield from _by_document(ids[p[head]], twins[p[head]], s[head].astype(np.int64), s[tail].astype(np.int64) + 1)


def _kept(texts: Texts, marks: list[list[bytes]]) -> dict[str, np.ndarray | list]:
    n_removed, n_spans, sha = np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64), []
    for i in range(texts.n):
        own = texts.buf[texts.offs[i] : texts.offs[i + 1]]
        if marks[i]:
            pairs = np.concatenate([np.frombuffer(x, np.int32) for x in marks[i]]).reshape(-1, 2).astype(np.int64)
            step = np.zeros(len(own) + 1, np.int32)
            np.add.at(step, pairs[:, 0], 1)
            np.add.at(step, pairs[:, 1] + LENGTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            n_removed[i] = gone.sum()
            n_spans[i] = (gone[1:] & ~gone[:-1]).sum() + gone[0]
            own = own[~gone]
        sha.append(hashlib.sha256(own.tobytes()).hexdigest())
    return {"n_bytes": np.diff(texts.offs), "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": sha}


def suffix_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    total = text_bytes(docs)
    buckets, salts = buckets_for(3.4 * total, BUCKET_BYTES), salts or salts_for(total)  # so many bytes travel for one of text
    return applied(docs, decided(pieces(docs, buckets, salts), buckets, _resolve, _combined, salts), buckets_for(total, PART_BYTES), _kept, RESULT)
