"""Quality rules from tokeniser fertility.

Public vocabularies split every whole text: one with byte fallback, and one of byte pairs. Per document and vocabulary that gives characters
per token, the share of tokens that are parts of characters (bytes that a character fell back to), and the entropy of the tokens over the
most it could be. Each language (or script, where none is given) has a band for each of these measures, from
the quartiles of all its documents of `MIN_WORDS` words or more that pass the rules below: beyond `reach` times the distance
of a quartile from the median, a measure rejects; a document goes where some measure rejects it by all vocabularies. Bands narrower than `LEAST` are widened, and
so are those of short documents. Quartiles are those of measures rounded to thousandths, so they are exact and the same in every run.

Texts are split at white space, as the vocabularies do themselves, so a word's tokens depend on the
word alone: each distinct word of a slice is split once.

The rules on words and lines: fewer than 50 words, or more than half of them in repeated windows
of three, reject as well.

Defined results: a null or wordless text has zero counts and fails; a language without any document for its quartiles rejects none;
repeated rows give repeated rows; a null lang goes by script (a tie goes to the first in SCRIPTS); a text of any length is read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafgate.llm.tables import written
from leafgate.llm.textarrays import NON_SPACE, Texts, U, Words, chunks, ragged

MIN_WORDS = 50
#: From labels of sf0.1: the README has how many clean and junk documents go by reach.
REACH = 4.5
BROADCAST_GROUPS = 10_000
SLICE = 3 << 20
KEPT_WORDS = 300_000
#: Least half-width of a band, for each measure.
LEAST = {"chars_per_token": 0.02, "fallback_share": 0.05, "entropy_ratio": 0.05}
#: Measures of fewer tokens vary more: bands are wider by the root of 1 + SHORT / tokens.
SHORT = 500
#: Scripts by first code point of a block; a text's script is that of most of its letters. Fixed values.
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0x1100, "hangul"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = tuple(LEAST)
#: How byte-pair vocabularies cut words before pairs are merged: letters, digits, others. A fixed value.
CUT = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _per_text(texts: Texts, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[texts.offs[1:]] - total[texts.offs[:-1]]


def base_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    lead = (texts.buf & 0xC0) != 0x80
    out = {
        "n_words": words.count,
        "word_chars": _per_text(texts, lead & NON_SPACE[texts.buf]),
        "n_symbols": _per_text(texts, _SYMBOL[texts.buf]),
    }
    start, end = texts.runs(_LINE)
    doc = texts.doc_of(start)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[filled], end[filled], doc[filled]
    h = texts.hashes(start, end)
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][again], minlength=texts.n)
    three, whole = words.windows(3)
    at = np.flatnonzero(whole)
    order = at[np.argsort(three[at] ^ (words.doc[at].astype(U) * U(0x9E3779B97F4A7C15)), kind="stable")]
    same = (three[order][1:] == three[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(words.hash), bool)
    for j in range(3):
        hit[order[twice] + j] = True
    out["n_repeat_words"] = np.bincount(words.doc[hit], minlength=texts.n)
    return out


def _script(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    names = np.array([s for _, s in SCRIPTS], object)
    block = np.searchsorted(np.array([b for b, _ in SCRIPTS]), codes, "right") - 1
    table = np.zeros((n, len(names)), np.int64)
    np.add.at(table, (doc[block >= 0], block[block >= 0]), 1)
    return names[table.argmax(1)]


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class Splitter:
    """Tokens of words by a vocabulary (a SentencePiece model, or byte pairs as ranks); those of frequent words are kept."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            model = tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [model.encode_ordinary(" " + t) for t in texts]
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[rank for token, rank in ranks.items() if not _whole(token)]] = True
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
        self.hash, self.size, self.first, self.tokens = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all tokens in order."""
        own, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, own), max(0, len(self.hash) - 1))
        old = self.hash[at] == own if len(self.hash) else np.zeros(len(own), bool)
        new = one[~old]
        buf = words.texts.buf
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[new], words.end[new])]
        split = self.encode(texts) if texts else []
        size = np.empty(len(own), np.int64)
        first = np.empty(len(own), np.int64)
        size[old], first[old] = self.size[at[old]], self.first[at[old]]
        added = np.fromiter(map(len, split), np.int64, len(split))
        size[~old], first[~old] = added, len(self.tokens) + np.cumsum(added) - added
        tokens = np.concatenate([self.tokens, np.fromiter((t for x in split for t in x), np.int32, int(added.sum()))])
        all_tokens = tokens[ragged(first[which], size[which])]
        if len(self.hash) + len(new) <= KEPT_WORDS:
            keys = np.concatenate([self.hash, own[~old]])
            order = np.argsort(keys)
            self.hash, self.size = keys[order], np.concatenate([self.size, size[~old]])[order]
            self.first, self.tokens = np.concatenate([self.first, first[~old]])[order], tokens
        return size[which], all_tokens


def measures(texts: Texts, words: Words, splitter: Splitter, word_chars: np.ndarray) -> dict[str, np.ndarray]:
    n = texts.n
    size, tokens = splitter(words)
    doc = np.repeat(words.doc, size)
    n_tokens = np.bincount(doc, minlength=n)
    back = np.bincount(doc, splitter.is_byte[tokens], n)
    cell, times = np.unique(doc.astype(np.int64) << 32 | tokens, return_counts=True)
    d = cell >> 32
    entropy = np.log2(np.maximum(n_tokens, 1)) - np.bincount(d, times * np.log2(times), n) / np.maximum(n_tokens, 1)
    most = np.log2(np.clip(n_tokens, 2, len(splitter.is_byte)))
    return {"chars_per_token": word_chars / np.maximum(n_tokens, 1), "fallback_share": back / np.maximum(n_tokens, 1), "entropy_ratio": entropy / most, "n_tokens": n_tokens}


def _name(measure: str, k: int) -> str:
    """Of the k-th vocabulary."""
    return measure if k == 0 else f"{measure}_{k + 1}"


def measured(docs: DataFrame, vocabularies: list[str]) -> DataFrame:
    """Counts and measures per document. vocabularies: paths of their files on every executor."""
    columns = [_name(m, k) for k in range(len(vocabularies)) for m in (*MEASURES, "n_tokens")]
    schema = ", ".join([BASE, *(f"{c} {'long' if c.startswith('n_tokens') else 'double'}" for c in columns), "grp string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = [Splitter(path) for path in vocabularies]
        for batch, texts in chunks(batches, most=SLICE):
            words = Words(texts, NON_SPACE)
            base = base_counts(texts, words)
            more = [measures(texts, words, s, base["word_chars"]) for s in splitters]
            lang = np.array(batch.column("lang").to_pylist(), object)
            blank = np.flatnonzero(lang == None)  # noqa: E711
            for i in blank:
                codes = np.array([ord(c) for c in texts.buf[texts.offs[i] : texts.offs[i + 1]].tobytes().decode("utf-8", "replace") if c.isalpha()] or [0])
                lang[i] = "script:" + _script(codes, np.zeros(len(codes), np.int64), 1)[0]
            ints = [pa.array(base[c], pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            found = [pa.array(own[m], pa.int64() if m == "n_tokens" else pa.float64()) for own in more for m in (*MEASURES, "n_tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ints, *found, pa.array(lang, pa.string())], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, schema)


def bands(rows: DataFrame, names: list[str]) -> DataFrame:
    """grp, and of each measure its quartiles. Rounded values are counted, and quartiles taken of the counts: the table between is bounded by what values there are."""
    each = F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.round(n, 3))))).alias("measure", "value")
    counts = rows.select("grp", each).groupBy("grp", "measure", "value").agg(F.count("*").alias("n"))
    quartiles = counts.groupBy("grp", "measure").agg(F.percentile("value", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    return quartiles.groupBy("grp").agg(*(F.max(F.when(F.col("measure") == n, F.col("q"))).alias(f"_{n}") for n in names))


def quality(docs: DataFrame, vocabularies: list[str], reach: float = REACH) -> DataFrame:
    """Per document: the counts, base_failed, kept, and the measures."""
    rows = written(measured(docs, vocabularies), "fertility").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    names = [_name(m, k) for k in range(len(vocabularies)) for m in MEASURES]
    usual = bands(rows.where("n_words >= 50 and not base_failed"), names)
    if usual.count() <= BROADCAST_GROUPS:  # a row for each language: no shuffle by language, which may be hot
        usual = F.broadcast(usual)

    def rejected(measure: str, k: int) -> F.Column:
        c = _name(measure, k)
        low, mid, high = (F.col(f"_{c}")[i] for i in range(3))
        wide, least = F.sqrt(1 + SHORT / F.greatest(_name("n_tokens", k), F.lit(1))), F.lit(LEAST[measure])
        return F.coalesce((F.col(c) < mid - wide * F.greatest(reach * (mid - low), least)) | (F.col(c) > mid + wide * F.greatest(reach * (high - mid), least)), F.lit(False))

    out = F.lit(False)
    for measure in MEASURES:
        by_all = F.lit(True)
        for k in range(len(vocabularies)):
            by_all &= rejected(measure, k)
        out |= by_all
    judged = rows.join(usual, "grp", "left").withColumn("kept", ~F.col("base_failed") & ~out)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *names, *(_name("n_tokens", k) for k in range(len(vocabularies))), F.col("grp").alias("band"))
