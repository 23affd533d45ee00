"""Language identification by interpolated Kneser-Ney character models.

One model of order `ORDER` per language over the letters of a word with its ends, kept as sorted
64-bit n-gram hashes with their discounted probabilities, and sorted context hashes with their
back-off mass. A text goes to the language of the lowest cross-entropy per character. A text is
rejected where even that lies above the limit of its language. Limits come from pieces of `PIECE` letters of the one in `CALIBRATION` sampled documents
that are held back: their median entropy, and the larger of `SPREADS` spreads (median to ninth decile) and `NOISE` of the way to the entropy of noise.
A language with fewer than `FEW` pieces has the limits of all pieces together, and without any piece the limit is from noise alone: there is always one.

Training reads whole texts of a bounded sample: about `sample_bytes` per language (a hash of the
doc_id decides, so the sample is the same in every run). The model that is sent to the executors
is bounded by that. Prediction reads nothing but the text.

Defined results: a null or letterless text is `und` with score 0 and rejected; ties go to the
language that sorts first; without any labelled text all is `und`; repeated rows give repeated
rows; extra columns are ignored (query) or passed on (stage).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leafgate.llm.tables import sifted
from leafgate.llm.textarrays import FOLDED, LETTERS, Texts, U, Words, chunks, mix, powers, ragged

ORDER = 5
SAMPLE_BYTES = 3_000_000
#: One in so many sampled documents is not learned from, but sets the threshold of rejection.
CALIBRATION = 8
#: A text is rejected only beyond so much of the way from its language's entropy to that of noise, and so many spreads.
NOISE, SPREADS, PIECE, FEW = 0.6, 8, 200, 20
CACHE = 1_500_000
CHUNK = 2 << 20
PAD, END = 1, 2
_ASCII_LETTER = re.compile("[A-Za-z]")
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def distinct_words(texts: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of letters; index of one occurrence of each distinct word; for every word its distinct word."""
    words = Words(texts, LETTERS, FOLDED)
    _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
    return words, at, which


def lowered(texts: Texts, words: Words, at: np.ndarray) -> str:
    """The words, lower-cased, each followed by a line feed."""
    length = words.end[at] - words.start[at] + 1
    data = np.full(int(length.sum()), 10, np.uint8)
    to = np.cumsum(length) - length
    data[ragged(to, length - 1)] = texts.buf[ragged(words.start[at], length - 1)]
    return data.tobytes().decode("utf-8", "replace").lower()


class Grams:
    """Hashes of the n-grams, n = 1 to ORDER, that end at each character or word end."""

    def __init__(self, lines: str):
        code = np.frombuffer(lines.encode("utf-32-le"), np.uint32).astype(U) + U(3)
        ends = np.flatnonzero(code == U(13))
        begin = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        length = ends - begin
        size = length + ORDER  # ORDER - 1 marks before, the letters, one mark after
        to = np.cumsum(size) - size
        full = np.full(int(size.sum()), PAD, U)
        at = ragged(to + ORDER - 1, length)
        full[at] = code[ragged(begin, length)]
        full[to + size - 1] = END
        p = powers(0x9FB21C651E98DF25, ORDER)
        self.at = ragged(to + ORDER - 1, length + 1)
        self.word = np.repeat(np.arange(len(length)), length + 1)
        self.hash: list[np.ndarray] = []  # at every place of the padded text
        run = np.zeros(len(full), U)
        for n in range(ORDER):
            run = run.copy()
            run[n:] += full[: len(full) - n] * p[n]
            self.hash.append(mix(run + U(n + 1)))

    def ending(self, n: int, at: np.ndarray) -> np.ndarray:
        return self.hash[n - 1][at]


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return own, np.bincount(which, weights, len(own)), at


class Model:
    """Of several languages. For each, by order: n-gram hashes, their part of the probability, context hashes, their back-off mass."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.langs = sorted(words)
        self.tables = []
        letters = {c for each in words.values() for w in each for c in w}
        self.floor = 1.0 / (len(letters) + 2)
        self.limits = {}
        for lang in self.langs:
            names = list(words[lang])
            grams = Grams("\n".join(names) + "\n" if names else "")
            counts = np.array([words[lang][w] for w in names], float)[grams.word]
            at, weight = grams.at, counts
            orders = []
            for n in range(ORDER, 0, -1):
                own, total, one = _grouped(grams.ending(n, at), weight)
                at = at[one]  # one place for each n-gram: its shorter ones are counted once for each of these
                ctx = grams.ending(n - 1, at - 1) if n > 1 else np.zeros(len(own), U)
                c, mass, _ = _grouped(ctx, total)
                kinds = np.bincount(np.searchsorted(c, ctx), minlength=len(c))
                ones, twos = (total == 1).sum(), (total == 2).sum()
                d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
                alpha = np.maximum(total - d, 0) / mass[np.searchsorted(c, ctx)]
                orders.append((own, alpha.astype(np.float32), c, (np.minimum(d, total.min()) * kinds / mass).astype(np.float32)))
                weight = np.ones(len(own))
            self.tables.append(orders[::-1])

    def bits(self, grams: Grams, at: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the character at each place, by language."""
        out = np.empty((len(at), len(self.langs)), np.float32)
        hashes = [grams.ending(n, at) for n in range(1, ORDER + 1)]
        before = [np.zeros(len(at), U)] + [grams.ending(n, at - 1) for n in range(1, ORDER)]
        for k, orders in enumerate(self.tables):
            p = np.full(len(at), self.floor)
            for (own, alpha, ctx, gamma), h, c in zip(orders, hashes, before):
                i = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                j = np.minimum(np.searchsorted(own, h), len(own) - 1)
                p = np.where(ctx[i] == c, np.where(own[j] == h, alpha[j], 0) + gamma[i] * p, p)
            out[:, k] = -np.log2(np.maximum(p, 1e-12))
        return out


class Scorer:
    """Cross-entropies of texts. What is known of an n-gram is kept, up to CACHE n-grams."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.bits = np.zeros(0, U), np.zeros((0, len(model.langs)), np.float32)

    def _of(self, grams: Grams) -> np.ndarray:
        own, one, which = np.unique(grams.ending(ORDER, grams.at), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        old = self.known[at] == own if len(self.known) else np.zeros(len(own), bool)
        bits = np.empty((len(own), len(self.model.langs)), np.float32)
        bits[old] = self.bits[at[old]]
        if not old.all():
            bits[~old] = new = self.model.bits(grams, grams.at[one[~old]])
            if len(self.known) + len(new) <= CACHE:
                both = np.concatenate([self.known, own[~old]])
                order = np.argsort(both)
                self.known, self.bits = both[order], np.concatenate([self.bits, new])[order]
        return bits[which]

    def by_word(self, texts: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of texts, bits by word and language, and characters by word."""
        words, at, which = distinct_words(texts)
        n_lang = len(self.model.langs)
        if not len(at) or not n_lang:
            return words, np.zeros((len(which), n_lang)), np.zeros(len(which))
        grams = Grams(lowered(texts, words, at))
        each = self._of(grams)
        bits = np.stack([np.bincount(grams.word, each[:, k], len(at)) for k in range(n_lang)], axis=1)
        return words, bits[which], np.bincount(grams.word, minlength=len(at))[which]

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits by text and language, and characters by text."""
        words, bits, chars = self.by_word(texts)
        out = np.zeros((texts.n, bits.shape[1]))
        for k in range(bits.shape[1]):
            out[:, k] = np.bincount(words.doc, bits[:, k], texts.n)
        return out, np.bincount(words.doc, chars, texts.n)

    def pieces(self, texts: Texts, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each full piece of the texts: its text, and its entropy in the language of that text."""
        words, bits, chars = self.by_word(texts)
        own = np.array([self.model.langs.index(x) if x in self.model.langs else -1 for x in langs])
        before = np.cumsum(chars) - chars
        first = words.first[:-1]
        begin = before[np.minimum(first, len(before) - 1)] if len(before) else np.zeros(texts.n)
        known = own[words.doc] >= 0
        key = (words.doc.astype(np.int64) << 40 | ((before - begin[words.doc]) // PIECE).astype(np.int64))[known]
        piece, which = np.unique(key, return_inverse=True)
        n = np.bincount(which, chars[known], len(piece))
        total = np.bincount(which, bits[np.arange(len(bits)), own[words.doc]][known], len(piece)) if len(piece) else n
        full = n >= PIECE / 2
        return (piece >> 40)[full], (total / np.maximum(n, 1))[full]


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: the labelled documents (doc_id, text, lang) to learn from."""
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], int(min(1.0, sample_bytes / max(1, r["n"])) * 1_000_000)).otherwise(share)
    sample = docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1_000_000)) < share)
    kept_back = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(1)), F.lit(CALIBRATION)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words, at, which = distinct_words(texts)
            names = np.array(lowered(texts, words, at).split("\n")[:-1], object)
            langs, lang = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            pair, n = np.unique(lang[words.doc] * len(at) + which, return_counts=True)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(langs[pair // len(at)], pa.string()), pa.array(names[pair % len(at)], pa.string()), pa.array(n)], ["lang", "word", "n"])

    rows = sample.where(~kept_back).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    words: dict[str, dict[str, int]] = {}
    order = sorted(zip(rows["lang"].to_pylist(), rows["word"].to_pylist(), rows["n"].to_pylist()))
    for lang, word, n in order:
        words.setdefault(lang, {})[word] = n
    model = Model(words)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in chunks(batches):
            langs = batch.column("lang").to_pylist()
            doc, h = scorer.pieces(texts, langs)
            yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in doc], pa.string()), pa.array(h)], ["lang", "h"])

    middle = [F.percentile("h", p).alias(n) for p, n in ((0.5, "m"), (0.9, "top"))]
    seen = sample.where(kept_back).mapInArrow(calibrate, "lang string, h double")
    spread = {r["lang"]: r for r in seen.rollup("lang").agg(*middle, F.count("*").alias("n")).collect()}  # null: of all languages
    flat = -np.log2(model.floor)  # texts of several known languages stay: their entropy lies below that of noise
    for lang in model.langs:
        r = spread.get(lang)
        r = r if r and r["n"] >= FEW else spread.get(None)
        m, s = (r["m"], r["top"] - r["m"]) if r and r["n"] else (flat / 2, 0.0)
        model.limits[lang] = (m + max(SPREADS * s, NOISE * (flat - m)), s)
    return model


class Decision:
    """By text: index of the language or -1, score, bits per character, whether rejected."""

    def __init__(self, scorer: Scorer, texts: Texts):
        model = scorer.model
        bits, n = scorer(texts)
        self.lang = np.full(texts.n, -1)
        self.score, self.bits, self.rejected = np.zeros(texts.n), np.full(texts.n, np.nan), np.ones(texts.n, bool)
        if model.langs:
            h = bits / np.maximum(n, 1)[:, None]
            best = h.argmin(1)
            low = h[np.arange(texts.n), best]
            odds = 2.0 ** (-(h - low[:, None]) * np.minimum(n, 40)[:, None])
            ok = n > 0
            for i in np.flatnonzero(ok):  # marks beyond ASCII may be no letters
                text = texts.buf[texts.offs[i] : texts.offs[i + 1]].tobytes().decode("utf-8", "replace")
                ok[i] = bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))
            self.lang[ok], self.score[ok], self.bits[ok] = best[ok], (1 / odds.sum(1))[ok], low[ok]
            limit = np.array([model.limits[x][0] for x in model.langs])
            slack = np.array([SPREADS * model.limits[x][1] for x in model.langs])
            self.rejected = ~ok | (low > limit[best] + slack[best] * 60 / np.maximum(n, 1))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits_per_char, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*scorer.model.langs, "und"], object)
        for batch, texts in chunks(batches, most=CHUNK):
            d = Decision(scorer, texts)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[d.lang], pa.string()), pa.array(d.score), pa.array(d.bits, from_pandas=True), pa.array(d.rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, RESULT)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without rejected ones; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in chunks(batches, most=CHUNK):
            yield batch.filter(pa.array(~Decision(scorer, texts).rejected))

    return sifted(docs, run)
