"""Cross-tokenizer alignment by byte-owner arrays.

A text is encoded by two public vocabularies: A (byte-level pairs, a `tokenizers` file) gets a space and the text, B
(SentencePiece, which adds that space) the text. Each token owns some bytes of space and text: `np.repeat` of
token numbers by their lengths gives the owner of each byte, once for A and once for B. Where either owner changes, an overlap of an A and a B token
ends; where both change at once, both tokens end there: a cut. Cuts part the tokens into groups, and the pair of owners before
a cut is a link. Links are counted over all documents by pair of ids.

Both vocabularies never have a token across a space after a visible character (that is checked for B's pieces when it is
loaded; A's pattern starts anew at white space), so texts are cut into chunks there, and a task encodes and aligns each distinct chunk once.
Chunks are told apart by a hash, and compared byte by byte with the one that stands for them. A text with a chunk whose tokens do not give its
bytes is encoded whole once more, and has no tokens if they still differ.

Counts travel as distinct pairs of a document. If the counted pairs are `BROADCAST_PAIRS` at most they are sent to all tasks, else joined by shuffle, where
Spark splits frequent pairs; the rows are the same.

Defined results: null and empty texts, and those with a character that B gives back otherwise (U+2581), have zeros and ''; repeated rows count each, and each gives a
row; null doc_ids are allowed; of pairs with equal counts all are a B id's best; texts of any length are encoded whole, in some hundred bytes of memory
for each byte; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leafgate.llm.tables import written
from leafgate.llm.textarrays import Texts, chunks, ragged

SLICE, BROADCAST_PAIRS = 2 << 20, 1_000_000
KEPT_CHUNKS, KEPT_BYTES = 250_000, 64
#: Bytes of new chunks that are encoded together.
RUN = 1 << 14
#: A pair of ids in one number.
RADIX = 1 << 20


def _byte_of() -> dict[str, int]:
    """Which byte a letter of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: encodes texts as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are plain text
        letters = _byte_of()
        with open(path, encoding="utf-8") as f:
            spelt = json.load(f)
        vocab = spelt["model"]["vocab"] | {t["content"]: t["id"] for t in spelt["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """B: encodes texts that begin with a space without it, and adds it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of token numbers that share bytes, in order, and whether both end with the overlap. Both lists of lengths have the same sum."""
    a, b = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
    change_a, change_b = np.ones(len(a), bool), np.ones(len(b), bool)
    change_a[:-1], change_b[:-1] = a[1:] != a[:-1], b[1:] != b[:-1]
    last = np.flatnonzero(change_a | change_b)
    return a[last], b[last], change_a[last] & change_b[last]


def spaced(texts: Texts) -> Texts:
    """The texts that are not empty with a space before each."""
    filled = texts.offs[1:] > texts.offs[:-1]
    before = np.zeros(texts.n + 1, np.int64)
    np.cumsum(filled, out=before[1:])
    return Texts(np.insert(texts.buf, texts.offs[:-1][filled], 0x20), texts.offs + before)


def starts(texts: Texts) -> np.ndarray:
    """Where chunks start: at texts, and at spaces after a visible character, but for a text's last byte. Such characters are known by
    their bytes: ASCII, or of those of two to four bytes the ones whose first byte no white space has."""
    b = texts.buf
    if not len(b):
        return np.zeros(0, np.int64)
    space = np.flatnonzero(b == 0x20)
    space = space[space >= 4]
    one, two, three, four = (b[space - i] for i in (1, 2, 3, 4))
    seen = (one > 0x20) & (one < 0x7F)
    tail, tail2, tail3 = one & 0xC0 == 0x80, two & 0xC0 == 0x80, three & 0xC0 == 0x80
    seen |= tail & (two >= 0xC3) & (two <= 0xDF)
    seen |= tail & tail2 & ((three == 0xE0) | (three >= 0xE4) & (three <= 0xEF))
    seen |= tail & tail2 & tail3 & (four >= 0xF0)
    cut = np.zeros(len(b) + 1, bool)
    cut[space[seen]] = True
    cut[texts.offs[1:][texts.offs[1:] > 0] - 1] = False
    cut[texts.offs[:-1]] = True
    cut[len(b)] = False
    return np.flatnonzero(cut)


class Aligner:
    """Alignments of chunks. Short chunks are kept for later slices, up to a number of them.

    Of chunk i: sizes[i] has its numbers of A tokens, B tokens, groups and links; said[i] spells its groups; links are pairs[first[i] : first[i] + links].
    A chunk whose tokens do not give its bytes has -1 A tokens."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.len_a, self.len_b = (np.array(list(map(len, v.bytes))) for v in (self.a, self.b))
        name = lambda n, end: [f"{i}{end}" for i in range(n)]
        #: How a token is spelt: A's inside a group, A's last in it, B's inside, B's last.
        self.spelt = np.array([*name(len(self.len_a), ","), *name(len(self.len_a), "|"), *name(len(self.len_b), ","), *name(len(self.len_b), ";")], object)
        self.known: dict[bytes, int] = {}
        self.sizes, self.said = np.zeros((0, 4), np.int64), np.zeros(0, object)
        self.first, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """A number for each of the given distinct chunks."""
        new = [i for i, c in enumerate(found) if c not in self.known]
        out = np.array([self.known.get(c, -1) for c in found], np.int64)
        if new:
            out[new] = len(self.said) + np.arange(len(new))
            self._add([found[i] for i in new])
            keep = [i for i in new if len(found[i]) <= KEPT_BYTES][: max(0, KEPT_CHUNKS - len(self.known))]
            self.known |= {found[i]: int(out[i]) for i in keep}
        return out

    def forget(self) -> None:
        """All but the chunks that are kept goes."""
        at = np.fromiter(self.known.values(), np.int64, len(self.known))
        links = self.sizes[at, 3]
        self.pairs = self.pairs[ragged(self.first[at], links)]
        self.sizes, self.said, self.first = self.sizes[at], self.said[at], np.cumsum(links) - links
        self.known = {c: i for i, c in enumerate(self.known)}

    def tokens(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, how many of each chunk, and the same of B. Chunks are encoded in runs, where they may be cut again; those of a run whose tokens do not
        give its bytes one by one. A chunk whose own tokens don't has none."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        end = np.cumsum(size)
        raw = b"".join(new)
        again = np.zeros(len(raw) + 1, bool)
        again[starts(Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))] = self.b.cuts
        lead = end - size
        fresh = np.append(True, ~again[lead[1:]] | (lead[1:] // RUN != lead[:-1] // RUN))
        todo = list(zip(np.flatnonzero(fresh).tolist(), [*np.flatnonzero(fresh)[1:].tolist(), len(new)]))
        done = {}
        whole = lambda vocabulary, ids, x: b"".join(map(vocabulary.bytes.__getitem__, ids)) == x
        for _ in range(2):  # runs, then the single chunks of those that differ
            texts = [raw[lead[i] : end[j - 1]] for i, j in todo]
            said = [t.decode("utf-8", "replace") for t in texts]
            for (i, j), x, ids_a, ids_b in zip(todo, texts, self.a(said), self.b(said)):
                if whole(self.a, ids_a, x) and whole(self.b, ids_b, x):
                    done[i] = (j, ids_a, ids_b)
                elif j - i == 1:
                    done[i] = (j, [], [])
                    size[i] = 0
            todo = [(k, k + 1) for i, j in todo if i not in done for k in range(i, j)]
            if not todo:
                break
        rows = [done[i] for i in sorted(done)]
        to = np.cumsum(size)
        out = []
        for ids, length in (([r[1] for r in rows], self.len_a), ([r[2] for r in rows], self.len_b)):
            flat = np.fromiter((t for x in ids for t in x), np.int64, sum(map(len, ids)))
            out += [flat, np.diff(np.searchsorted(np.cumsum(length[flat]), to, "right"), prepend=0)]
        return tuple(out)

    def _add(self, new: list[bytes]) -> None:
        a, n_a, b, n_b = self.tokens(new)
        over_a, over_b, cut = overlaps(self.len_a[a], self.len_b[b])
        last_a, last_b = over_a[cut], over_b[cut]  # of each group; chunks end with a group
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[last_a] = ends_b[last_b] = True
        group_a, group_b = (np.cumsum(e) - e for e in (ends_a, ends_b))
        of_a, of_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # tokens of each group
        order = np.empty(len(a) + len(b), np.int64)  # A's tokens of a group, then B's
        order[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = a + ends_a * len(self.len_a)
        order[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = 2 * len(self.len_a) + b + ends_b * len(self.len_b)
        words = self.spelt[order].tolist()
        to = np.cumsum(n_a + n_b)
        groups = np.bincount(np.repeat(np.arange(len(new)), n_a)[last_a], minlength=len(new))
        said = np.empty(len(new), object)
        said[:] = ["".join(words[x - n : x]) for x, n in zip(to.tolist(), (n_a + n_b).tolist())]
        sizes = np.stack([np.where(n_a > 0, n_a, -1), n_b, groups, groups], 1)
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(groups) - groups])
        self.pairs = np.concatenate([self.pairs, a[last_a] * RADIX + b[last_b]])
        self.sizes, self.said = np.concatenate([self.sizes, sizes]), np.concatenate([self.said, said])

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Chunks in order: their numbers, and first[d] : first[d + 1] are those of text d. Texts whose tokens do not give their bytes have none."""
        self.forget()
        whole = spaced(texts)
        start = starts(whole) if self.b.cuts else whole.offs[:-1][np.diff(whole.offs) > 0]
        end = np.append(start[1:], len(whole.buf))[: len(start)]
        _, one, which = np.unique(whole.hashes(start, end), return_index=True, return_inverse=True)
        stands = one[which]
        size = end - start
        differs = size != size[stands]
        same = np.flatnonzero(~differs & (stands != np.arange(len(stands))))
        apart = whole.buf[ragged(start[same], size[same])] != whole.buf[ragged(start[stands[same]], size[same])]
        bad = np.zeros(texts.n, bool)
        chunk_doc = np.searchsorted(whole.offs, start, "right") - 1
        bad[chunk_doc[differs]] = True
        bad[np.repeat(chunk_doc[same], size[same])[apart]] = True
        raw = whole.buf.tobytes()
        number = self.numbers([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])[which]
        bad[chunk_doc[self.sizes[number, 0] < 0]] = True
        first = np.searchsorted(start, whole.offs)
        if bad.any():  # these texts are one chunk each, or none
            parts = [number[first[d] : first[d + 1]] for d in range(texts.n)]
            for d in np.flatnonzero(bad):
                n = self.numbers([raw[whole.offs[d] : whole.offs[d + 1]]])
                parts[d] = n[self.sizes[n, 0] >= 0]
            number, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        return number, first


def aligned(docs: DataFrame, a: str, b: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (or their sha256), and distinct links: pairs (A id * RADIX + B id) and how often (times).
    a, b: paths of the vocabularies on every executor."""
    groups = "groups_sha256" if digest else "groups"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch, texts in chunks(batches, most=SLICE):
            number, first = aligner(texts)
            sizes = np.zeros((len(number) + 1, 4), np.int64)
            np.cumsum(aligner.sizes[number], axis=0, out=sizes[1:])
            per = sizes[first[1:]] - sizes[first[:-1]]
            said = ["".join(aligner.said[number[x:y]].tolist())[:-1] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            if digest:
                said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
            links = aligner.sizes[number, 3]
            pairs = aligner.pairs[ragged(aligner.first[number], links)]
            doc = np.repeat(np.arange(texts.n), per[:, 3])
            order = np.lexsort((pairs, doc))
            pairs, doc = pairs[order], doc[order]
            lead = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1]))) if len(pairs) else np.zeros(0, np.int64)
            times = np.diff(np.append(lead, len(pairs)))
            offs = np.searchsorted(doc[lead], np.arange(texts.n + 1))
            lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(v, t)) for v, t in ((pairs[lead], pa.int64()), (times, pa.int32()))]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", groups, "pairs", "times"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(per[:, j], pa.int64()) for j in range(4)), pa.array(said, pa.string()), *lists], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {groups} string, pairs array<long>, times array<int>")


def _exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """columns, pair, times: a row for each distinct link of a document."""
    return rows.select(*columns, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select(*columns, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count, best: whether no pair of its B id has a higher count. A B id has as many rows as there are A ids at most."""
    counts = _exploded(rows).where("pair is not null").groupBy("pair").agg(F.sum("times").alias("count"))
    of_b = Window.partitionBy(F.col("pair") % RADIX)
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def alignments(docs: DataFrame, a: str, b: str, digest: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (or groups)."""
    rows = written(aligned(docs, a, b, digest), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256" if digest else "groups"]
    linked = _exploded(rows.withColumn("_row", F.monotonically_increasing_id()), "_row", *own).join(counts, "pair", "left")
    sums = linked.groupBy("_row", *own).agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).cast("long").alias("n_best"), F.coalesce(F.sum(F.col("count") * F.col("times")), F.lit(0)).cast("long").alias("count_sum")
    )
    return sums.drop("_row")
