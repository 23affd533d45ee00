"""Language-model scores by a hashed maximum-entropy model.

Tokens are the words (split at white space, A-Z lower-cased), then one end for each text. Words
are known by a 64-bit hash. The most frequent words and the hashed endings of all others are `SYMBOLS`
symbols; symbols with like neighbours share one of `CLASSES` classes. A token's probability is

    P(class | the three classes before)  P(word | class, the two words before)

Both factors are maximum-entropy models, trained by gradient steps. The first is a softmax over n-gram and skip features of
the classes before, hashed into `ROWS` rows of weights: each step sends the weights to all tasks, each task
adds up the gradient of its part of the counted contexts, and the parts are summed up. Contexts are counted
over all training texts first, so a step sees every training token without reading it again.

The second is a softmax over the words of the class: the class's own distribution (given the class before), times the
weights of two features: the word with the word before it, and the word with both words before it. There is a weight for each such n-gram of the
training texts, so what is learned grows with the input. Tokens go to a shard by the hash of the word before, where all that touches
one weight meets; a shard sums the counts, trains its weights by gradient steps under a Gaussian prior (bigrams first, then trigrams upon
them), and scores the tokens of all documents as sparse arrays: the sum that normalises a context is one, and what the weights of its
own n-grams change. A word before that is frequent has weights for each of several groups of words before that (its count and `HOT` decide how many), by their hash: a
group is a feature of the context, and learns from all training texts. The tokens of a pair of words that is `HOT` times there go to several shards, by document. For the groups of such
pairs the counts of all training texts are summed up apart and sent to each of these shards, so all of them train the same weights. So hot words, hot pairs and the starts of texts go to
many shards, and what a shard holds does not grow with the input. Weights never leave their shard.

Documents are numbered in blocks of some `HELD_TOKENS` tokens. A shard answers each block's pack with a sum (32-bit) for each document in it; only one pack of a block names its documents.

The classes' distribution of words that are no symbols is their share of the words of their ending, with half a count for each and for the
unknown. So the model's probabilities of all words and one unknown for each ending add up to one.

The `KNOWN` most frequent words at most, and all symbols, are sent to all tasks. A word beyond them is predicted as one of the others of its ending;
these tokens are summed by document and word and joined with the whole count table, so every count is exact.

Defined results: a null or wordless text is its end alone; without training texts all tokens have the
probability of an unknown; a null doc_id is not held out; repeated rows give repeated rows; extra
columns are ignored. However long a text is, all of its tokens count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from leafgate.llm.tables import written
from leafgate.llm.textarrays import FOLDED, NON_SPACE, Texts, U, Words, chunks, mix

SYMBOLS, ENDINGS, CLASSES, ROWS = 4096, 1024, 32, 1 << 13
KNOWN = 500_000
NEIGHBOURS = 32
STEPS, RATE, PRIOR = 14, 0.25, 8.0
BLOCKS = 32
END_HASH = 0x1EAF6A7E
END_CLASS = CLASSES - 1
CONTEXTS = CLASSES**3
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
PARTIAL = "doc_id long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, ending int, times long"
#: Tokens of one shard, about; training tokens of one group of a word before, about (a group with a hot pair has more), and of a hot pair at least.
SHARD, HOT = 1_000_000, 200_000
#: Steps, the largest one, and the variance of the prior of n-gram weights; tokens of one block.
NGRAM_STEPS, LARGEST, VARIANCE, HELD_TOKENS = 10, 2.0, 4.0, 2_000_000
#: What a task holds at a time, about: bytes of packs that it sends, n-grams of a shard whose weights it trains.
SENT_BYTES, TRAINED = 2_000_000, 250_000
TOKENS = "shard int, counts boolean, data binary"
#: What stands for no word before, and for all words before that make no hot pair.
START, REST = -1, 2**31 - 2


def _keyed_docs(docs: DataFrame) -> DataFrame:
    """doc_id, doc (a key of the row's values; odd if it is trained on), held_out, text."""
    held = held_out(F.col("doc_id"))
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR((~held).cast("long"))
    return docs.select("doc_id", key.alias("doc"), held.alias("held_out"), "text")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _endings(texts: Texts, words: Words) -> np.ndarray:
    return (texts.hashes(np.maximum(words.start, words.end - 3), words.end, FOLDED) % U(ENDINGS)).astype(np.int64)


@dataclass
class Lexicon:
    """The most frequent words: sorted hashes, counts, endings, symbols (-1: its ending's). Of each ending: tokens and words that are no symbols."""

    hash: np.ndarray
    count: np.ndarray
    ending: np.ndarray
    symbol: np.ndarray
    end_symbol: int
    tokens: int
    distinct: int
    ending_tokens: np.ndarray
    ending_words: np.ndarray

    @property
    def end(self) -> int:
        """Place of the end."""
        return int(np.searchsorted(self.hash, U(END_HASH)))

    @property
    def room(self) -> np.ndarray:
        """Of each ending: counts of its words, with half a count for each and for the unknown."""
        return self.ending_tokens + 0.5 * (self.ending_words + 1)

    @property
    def other_room(self) -> np.ndarray:
        """The part of words that are not known here, and of the unknown."""
        rare = self.symbol < 0
        return self.room - np.bincount(self.ending[rare], self.count[rare] + 0.5, ENDINGS)

    def find(self, words: Words) -> np.ndarray:
        """Place of each word, or -1."""
        if not len(self.hash):
            return np.full(len(words.hash), -1)
        own, which = np.unique(words.hash, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        return np.where(self.hash[at] == own, at, -1)[which]


class Sequence:
    """The tokens of texts as symbols, each text's end included."""

    def __init__(self, texts: Texts, lexicon: Lexicon):
        self.words = words = Words(texts, NON_SPACE, FOLDED)
        self.place = lexicon.find(words)
        self.ending = _endings(texts, words)
        first = SYMBOLS - ENDINGS
        symbol = np.where(self.place >= 0, lexicon.symbol[self.place] if len(lexicon.symbol) else -1, -1)
        self.is_rare = symbol < 0
        self.at = np.arange(len(words.hash)) + words.doc
        self.symbol = np.full(len(words.hash) + texts.n, lexicon.end_symbol)
        self.symbol[self.at] = np.where(self.is_rare, first + self.ending, symbol)
        self.doc = np.repeat(np.arange(texts.n), words.count + 1)
        self.step = np.arange(len(self.symbol)) - (words.first[:-1] + np.arange(texts.n))[self.doc]

    def before(self, values: np.ndarray, k: int, start: int) -> np.ndarray:
        """The value k tokens before each, or start before a text."""
        out = np.full(len(values), start, values.dtype)
        out[k:] = values[: len(values) - k]
        return np.where(self.step >= k, out, start)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (hash), ending, n over all texts, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, texts_seen = 0, 0

        def summed() -> tuple[np.ndarray, ...]:
            word, ending, n = (np.concatenate(x) for x in zip(*held))
            own, at, which = np.unique(word, return_index=True, return_inverse=True)
            return own, ending[at], np.bincount(which, n, len(own)).astype(np.int64)

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64)), pa.array(rows[1], pa.int32()), pa.array(rows[2])], ["word", "ending", "n"])

        for _, texts in chunks(batches):
            words = Words(texts, NON_SPACE, FOLDED)
            texts_seen += texts.n
            own, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            held.append((own, _endings(texts, words)[at].astype(np.int32), n))
            size += len(own)
            if size > 3_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield out(held.pop())
                    size = 0
        if texts_seen:
            held.append((np.array([END_HASH], U), np.array([0], np.int32), np.array([texts_seen])))
            yield out(summed())

    return docs.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def lexicon_of(vocab: DataFrame, known: int = KNOWN) -> Lexicon:
    """The words of the largest counts, so many that they stay within `known`."""
    level = F.floor(F.log2("n") * 16)
    levels = sorted(((r["l"], r["w"], r["n"]) for r in vocab.groupBy(level.alias("l")).agg(F.count("*").alias("w"), F.sum("n").alias("n")).collect()), reverse=True)
    tokens, distinct = sum(x[2] for x in levels), sum(x[1] for x in levels)
    taken, least = 0, None
    for lev, w, _ in levels:
        if taken + w > known:
            break
        taken, least = taken + w, lev
    # the symbols are the most frequent words and the end, however many words have one count
    top = vocab.where(F.col("word") != END_HASH).orderBy(F.desc("n"), "word").limit(SYMBOLS - ENDINGS - 1).unionByName(vocab.where(F.col("word") == END_HASH)).toArrow()
    rows = (vocab.where(level >= least) if least is not None else vocab.limit(0)).toArrow()
    rows = pa.concat_tables([rows, top.cast(rows.schema)])
    hashes, counts, endings = (rows[c].to_numpy() for c in ("word", "n", "ending"))
    hashes, one = np.unique(hashes.view(U), return_index=True)
    counts, endings = counts[one], endings[one]
    symbol = np.full(len(hashes), -1, np.int64)
    first = np.searchsorted(hashes, top["word"].to_numpy().view(U))
    symbol[first] = np.arange(len(first))
    end_symbol = SYMBOLS - ENDINGS - 1
    symbol[hashes == U(END_HASH)] = end_symbol
    by = vocab.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("w")).toArrow()
    ending_tokens, ending_words = np.zeros(ENDINGS), np.zeros(ENDINGS)
    ending_tokens[by["ending"].to_numpy()] = by["n"].to_numpy()
    ending_words[by["ending"].to_numpy()] = by["w"].to_numpy()
    is_symbol = symbol >= 0
    ending_tokens -= np.bincount(endings[is_symbol], counts[is_symbol], ENDINGS)
    ending_words -= np.bincount(endings[is_symbol], minlength=ENDINGS)
    if U(END_HASH) not in hashes:  # there are no training texts
        at = np.searchsorted(hashes, U(END_HASH))
        hashes, counts, endings, symbol = (np.insert(x, at, v) for x, v in ((hashes, U(END_HASH)), (counts, 0), (endings, 0), (symbol, end_symbol)))
    return Lexicon(hashes, counts, endings, symbol, end_symbol, tokens, distinct, ending_tokens, ending_words)


def counted(docs: DataFrame, size: int, count: Callable[[Texts], np.ndarray]) -> DataFrame:
    """block, data: the sums over all texts of arrays of `size` counts, in BLOCKS blocks. count: of a slice, the places to count."""
    each = -(-size // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each * BLOCKS, np.int64)
        for _, texts in chunks(batches):
            total += np.bincount(count(texts), minlength=len(total))
        press = zstandard.ZstdCompressor(level=1)
        used = [b for b in range(BLOCKS) if total[b * each : (b + 1) * each].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([press.compress(total[b * each : (b + 1) * each].tobytes()) for b in used], pa.binary())], ["block", "data"])

    def add(group: pa.Table) -> pa.Table:
        out = np.zeros(each, np.int64)
        for data in group["data"]:
            out += np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.int64)
        return pa.table({"block": group["block"].slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    return docs.select("text").mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary")


def _whole(blocks: DataFrame, size: int) -> np.ndarray:
    each = -(-size // BLOCKS)
    out = np.zeros(each * BLOCKS, np.int64)
    for r in blocks.collect():  # BLOCKS rows of a fixed size
        out[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["data"], np.int64)
    return out[:size]


def symbol_classes(docs: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Class of each symbol: k-means over the root shares of the most frequent words before and after it. The end is alone."""
    size = SYMBOLS * 2 * (NEIGHBOURS + 1)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(texts: Texts) -> np.ndarray:
        seq = Sequence(texts, shared.value)
        near = np.minimum(seq.symbol, NEIGHBOURS)
        before = seq.before(near, 1, NEIGHBOURS)
        after = np.append(near[1:], NEIGHBOURS) if len(near) else near
        row = seq.symbol * 2 * (NEIGHBOURS + 1)
        return np.concatenate([row + before, row + NEIGHBOURS + 1 + after])

    table = _whole(counted(docs, size, count), size).reshape(SYMBOLS, 2, NEIGHBOURS + 1).astype(float)
    usual = table.sum(0) + 1e-9
    usual /= usual.sum(1, keepdims=True)
    weight = table[:, 0].sum(1)
    shares = (table + 20 * usual) / (table.sum(2, keepdims=True) + 20)
    x = np.sqrt(shares / np.maximum(usual, 1e-9))[:, :, :NEIGHBOURS].reshape(SYMBOLS, -1) * np.sqrt(usual[:, :NEIGHBOURS]).reshape(1, -1)
    order = np.argsort(-weight, kind="stable")
    order = order[order != lexicon.end_symbol]
    centres = [x[order[0]]]
    for _ in range(CLASSES - 2):  # the next centre is the symbol that stands out most, by distance and root weight
        gap = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0) * np.sqrt(weight + 1)
        gap[lexicon.end_symbol] = -1
        centres.append(x[gap.argmax()])
    centre = np.array(centres)
    for _ in range(15):
        to = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for c in range(len(centre)):
            own = to == c
            if weight[own].sum() > 0:
                centre[c] = np.average(x[own], axis=0, weights=weight[own] + 1e-9)
    to[lexicon.end_symbol] = END_CLASS
    return to


def _features(context: np.ndarray) -> np.ndarray:
    """Rows of the weights for each context: n-grams and skips, hashed."""
    c1, c2, c3 = context // CLASSES**2, context // CLASSES % CLASSES, context % CLASSES
    keys = [np.zeros_like(c1), c1, c2, c3, c1 * CLASSES + c2, c1 * CLASSES + c3, context]
    return np.stack([(mix(k.astype(U) * U(len(keys)) + U(i)) % U(ROWS)).astype(np.int64) for i, k in enumerate(keys)])


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows].sum(0)
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z / z.sum(1, keepdims=True)


def trained(contexts: DataFrame, tokens: int) -> np.ndarray:
    """Weights (ROWS, CLASSES) from counted contexts (block, data: counts of context and class)."""
    spark = contexts.sparkSession
    each = CONTEXTS // BLOCKS
    scale = np.zeros(ROWS)

    def part(weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, seen = np.zeros((ROWS, CLASSES)), np.zeros(ROWS)
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                    n = np.frombuffer(data.as_py(), np.int64)[: each * CLASSES].reshape(each, CLASSES).astype(float)
                    some = np.flatnonzero(n.any(1))
                    rows, n = _features(some + block * each), n[some]
                    total = n.sum(1)
                    gap = n if shared.value is None else n - total[:, None] * _softmax(shared.value, rows)
                    for r in rows:
                        np.add.at(grad, r, gap)
                        np.add.at(seen, r, total)
            yield pa.RecordBatch.from_arrays([pa.array([grad.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["grad", "seen"])

        grad, seen = np.zeros((ROWS, CLASSES)), np.zeros(ROWS)
        for r in contexts.coalesce(8).mapInArrow(run, "grad binary, seen binary").toLocalIterator():  # eight parts at most
            grad += np.frombuffer(r["grad"], np.float32).reshape(ROWS, CLASSES)
            seen += np.frombuffer(r["seen"])
        shared.destroy()
        return grad, seen

    first, scale = part(None)
    usual = first[_features(np.zeros(1, np.int64))[0, 0]]
    usual = (usual + 1e-3) / (usual + 1e-3).sum()
    weights = np.log((first + PRIOR * usual) / (scale[:, None] + PRIOR)) - np.log(usual)
    weights *= 0.25
    weights[_features(np.zeros(1, np.int64))[0, 0]] = np.log(usual)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        grad, _ = part(weights)
        g = grad / (scale[:, None] + 50.0) - 1e-4 * weights  # the mean gap of a feature's tokens
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        weights = weights + RATE * (0.3 + 0.7 / step) * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 0.02)
    return weights


@dataclass
class Model:
    lexicon: Lexicon
    symbol_class: np.ndarray
    by_context: np.ndarray  # log10 of P(class | context)
    by_class: np.ndarray  # log of P(symbol | class, class before), by class before and symbol

    @cached_property
    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all that can be predicted: the symbol, and the log of its share of the symbol."""
        lexicon, first = self.lexicon, SYMBOLS - ENDINGS
        symbol_of = np.concatenate([np.where(lexicon.symbol >= 0, lexicon.symbol, first + lexicon.ending), first + np.arange(ENDINGS)]).astype(np.int32)
        return symbol_of, np.concatenate([np.where(lexicon.symbol >= 0, 0.0, np.log((lexicon.count + 0.5) / lexicon.room[lexicon.ending])), np.log(lexicon.other_room / lexicon.room)])


def fit(docs: DataFrame, vocab: DataFrame) -> Model:
    """docs: the training texts; vocab: their counts."""
    lexicon = lexicon_of(vocab)
    classes = symbol_classes(docs, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, classes))
    n_context, n_member = CONTEXTS * CLASSES, CLASSES * SYMBOLS
    own, behind = n_context // BLOCKS, n_member // BLOCKS  # of one block

    def places(texts: Texts) -> np.ndarray:
        """Contexts with their class and, behind these in each block, symbols with the class before."""
        lexicon, classes = shared.value
        seq = Sequence(texts, lexicon)
        c = classes[seq.symbol]
        before = seq.before(c, 1, END_CLASS)
        context = ((before * CLASSES + seq.before(c, 2, END_CLASS)) * CLASSES + seq.before(c, 3, END_CLASS)) * CLASSES + c
        member = before * SYMBOLS + seq.symbol
        return np.concatenate([context + context // own * behind, member + (member // behind + 1) * own])

    table = written(counted(docs, n_context + n_member, places), "contexts")
    weights = trained(table, lexicon.tokens)
    by_context = np.log10(np.maximum(_softmax(weights, _features(np.arange(CONTEXTS))), 1e-12)).astype(np.float32)
    members = table.select("block", F.expr(f"substring(data, {8 * own + 1}, {8 * behind})").alias("data"))
    n = _whole(members, n_member).reshape(CLASSES, SYMBOLS).astype(float)
    one_hot = np.zeros((SYMBOLS, CLASSES))
    one_hot[np.arange(SYMBOLS), classes] = 1
    used = np.arange(SYMBOLS) >= SYMBOLS - ENDINGS - 1  # the end and the endings; the others where there are so many words
    used[lexicon.symbol[lexicon.symbol >= 0]] = True
    used |= (used @ one_hot == 0)[classes]  # a class without any is its symbols' alike
    plain = np.where(used, n.sum(0) + 0.5, 0)
    plain /= (plain @ one_hot)[classes]
    per_class = n @ one_hot
    strength = 200.0
    p = (n + strength * plain) / (per_class[:, classes] + strength)
    return Model(lexicon, classes, by_context, np.log(np.maximum(p, 1e-30)).astype(np.float32))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document (word null), and one for each document and word that the lexicon lacks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lex = model.lexicon
        base_of = lambda c: np.log10((c + 0.5) / (lex.tokens + 0.5 * (lex.distinct + 1)))
        end_count = float(lex.count[lex.end])
        for batch, texts in chunks(batches):
            seq = Sequence(texts, lex)
            words, n = seq.words, texts.n
            c = model.symbol_class[seq.symbol]
            before = seq.before(c, 1, END_CLASS)
            context = (before * CLASSES + seq.before(c, 2, END_CLASS)) * CLASSES + seq.before(c, 3, END_CLASS)
            score = np.bincount(seq.doc, model.by_context[context, c], n)
            known = seq.place >= 0
            count = lex.count[seq.place[known]] if known.any() else np.zeros(0)
            base = np.bincount(words.doc[known], base_of(count), n) + base_of(end_count)
            n_known = np.bincount(words.doc[known], minlength=n) + (end_count > 0)
            ids, keys = batch.column("doc_id"), batch.column("doc")
            blank = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, keys, batch.column("held_out"), pa.array(words.count + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), blank, pa.nulls(n, pa.int32()), blank],
                [f.split()[0] for f in PARTIAL.split(", ")],
            )
            lost = np.flatnonzero(~known)
            if len(lost):
                order = lost[np.lexsort((words.hash[lost], words.doc[lost]))]
                new = np.ones(len(order), bool)
                new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
                at = np.flatnonzero(new)
                one, times = order[at], np.diff(np.append(at, len(order)))
                doc = pa.array(words.doc[one])
                none = pa.nulls(len(one), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(one), pa.int64()), keys.take(doc), pa.nulls(len(one), pa.bool_()), none, none, pa.nulls(len(one), pa.float64()), pa.nulls(len(one), pa.float64()), pa.array(words.hash[one].view(np.int64)), pa.array(seq.ending[one], pa.int32()), pa.array(times, pa.int64())],
                    [f.split()[0] for f in PARTIAL.split(", ")],
                )

    return _keyed_docs(docs).mapInArrow(run, PARTIAL)


def _outputs(seq: Sequence, lexicon: Lexicon) -> np.ndarray:
    """What is predicted at each token: the place of a known word, or, behind all those, the others of an ending."""
    out = np.full(len(seq.symbol), lexicon.end)
    out[seq.at] = np.where(seq.place >= 0, seq.place, len(lexicon.hash) + seq.ending)
    return out


def _names(seq: Sequence, lexicon: Lexicon) -> np.ndarray:
    """What a token is called as a word before, below 2**31: the place of a known word, or a hash that keeps the ending."""
    most = ((1 << 31) - 2 - len(lexicon.hash)) // ENDINGS
    out = np.full(len(seq.symbol), START)
    out[seq.at] = np.where(seq.place >= 0, seq.place, len(lexicon.hash) + (seq.words.hash >> U(33)).astype(np.int64) % most * ENDINGS + seq.ending)
    return out


def _often(before: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """How often a word before is in the training texts. Words that are not known are never hot."""
    count = np.append(lexicon.count, 0)
    return np.where(before < 0, lexicon.count[lexicon.end], count[np.clip(before, 0, len(lexicon.count))])


def _group(before: np.ndarray, before2: np.ndarray, doc: np.ndarray, lexicon: Lexicon, hot: int) -> np.ndarray:
    """Which group of its word before a token takes: by the word before that. The document has no part in it, so all training texts count for a group."""
    times = (_often(before, lexicon) // hot + 1).astype(U)
    return (mix(before2.astype(U) + U(11)) % times).astype(np.int64)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) + 1) << 32 | (second.astype(np.int64) + 1)


def _found(own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of x is in own (ascending), and where."""
    if not len(own):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
    return own[at] == x, at


class Hot:
    """The pairs of words that are `hot` times or more in the training texts, and in how many parts a pair's tokens are dealt, by document. The shards
    of such a pair's group learn from `shared` counts of all training texts."""

    def __init__(self, pair: np.ndarray, count: np.ndarray, lexicon: Lexicon, hot: int):
        order = np.argsort(pair)
        self.hot, self.pair, self.parts = hot, pair[order], count[order] // hot + 1
        before, before2 = (self.pair >> 32) - 1, (self.pair & 0xFFFFFFFF) - 1
        group = _paired(before, _group(before, before2, before, lexicon, hot))
        self.groups, which = np.unique(group, return_inverse=True)
        self.group_parts = np.ones(len(self.groups), np.int64)
        np.maximum.at(self.group_parts, which, self.parts)

    def parts_of(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """1 where the pair is not hot."""
        hot, at = _found(self.pair, _paired(before, before2))
        return np.where(hot, self.parts[at], 1) if len(self.pair) else np.ones(len(before), np.int64)


def hot_pairs(docs: DataFrame, lexicon: Lexicon, hot: int) -> Hot:
    """At most one for each `hot` tokens. Both words of a pair are as frequent as the pair, so only pairs of frequent words are counted."""
    none = np.zeros(0, np.int64)
    if not (lexicon.count >= hot).any():
        return Hot(none, none, lexicon, hot)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        pair, n = none, none
        for _, texts in chunks(batches):
            seq = Sequence(texts, lexicon)
            names = _names(seq, lexicon)
            before, before2 = seq.before(names, 1, START), seq.before(names, 2, START)
            some = (_often(before, lexicon) >= hot) & (_often(before2, lexicon) >= hot)
            new, times = np.unique(_paired(before[some], before2[some]), return_counts=True)
            pair, which = np.unique(np.concatenate([pair, new]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n, times]), len(pair)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= hot).toArrow()
    return Hot(rows["pair"].to_numpy(), rows["n"].to_numpy(), lexicon, hot)


def _home(before: np.ndarray, kind: np.ndarray, group: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a word before with a class and a group."""
    context = before * CLASSES + kind
    return ((mix(context.astype(U) * U(0x9E3779B97F4A7C15)) % U(shards) + group.astype(U)) % U(shards)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**31, byte by byte: those that hardly differ take little room when pressed."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view(np.int32).ravel()


def _packed(doc: np.ndarray, before: np.ndarray, before2: np.ndarray, out: np.ndarray, block: int = 0, keys: np.ndarray | None = None) -> bytes:
    """doc: of each token twice its document's number in the block, plus 1 if that is trained on. keys: the block's documents; one pack of a block names them."""
    order = np.argsort((before.astype(np.int64) + 1) << 32 | out)
    keys = np.zeros(0, np.int64) if keys is None else keys
    parts = [np.array([len(doc), block, len(keys)]).tobytes(), keys.tobytes(), *map(_planes, (doc[order], np.diff(before[order], prepend=START), before2[order], out[order]))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpacked(data: bytes) -> list:
    """doc, before, before2, out, block, keys."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, block, named = (int(x) for x in np.frombuffer(data, np.int64, 3))
    at = 24 + 8 * named
    doc, before, before2, out = (_of_planes(data, n, at + 4 * n * i) for i in range(4))
    return [doc, np.cumsum(before) + START, before2, out, block, np.frombuffer(data, np.int64, named, 24)]


def _dealt(docs: DataFrame, model: Model, shards: int, hot: int, pairs: Hot | None = None) -> DataFrame:
    """The tokens of all documents in shards, packed: doc, before, before2, out. Documents are numbered in blocks, which are known by a hash of their keys."""
    shared = docs.sparkSession.sparkContext.broadcast((model, pairs or hot_pairs(docs, model.lexicon, hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = shared.value
        held: list[list[np.ndarray]] = [[] for _ in range(5)]
        keys: list[np.ndarray] = []
        n_docs = 0

        def tokens(texts: Texts, key: np.ndarray) -> tuple[np.ndarray, ...]:
            """shard, number of the document, before, before2, out."""
            seq = Sequence(texts, model.lexicon)
            names = _names(seq, model.lexicon)
            before, before2 = seq.before(names, 1, START), seq.before(names, 2, START)
            doc = key[seq.doc]
            times = _often(before, model.lexicon) // hot + 1
            part = (mix(doc.astype(U) + U(5)) % pairs.parts_of(before, before2).astype(U)).astype(np.int64)
            shard = _home(before, model.symbol_class[seq.symbol], (_group(before, before2, doc, model.lexicon, hot) + part) % times, shards)
            number = (seq.doc + n_docs) << 1 | doc & 1
            return tuple(c.astype(np.int32) for c in (shard, number, before, before2, _outputs(seq, model.lexicon)))

        def sent() -> Iterator[pa.RecordBatch]:
            columns = []
            for c in held:  # one at a time: the slices of a column go as soon as it is whole
                columns.append(np.concatenate(c))
                c.clear()
            names = np.concatenate(keys)
            keys.clear()
            block = int(mix(names.astype(U) + mix(np.arange(len(names)).astype(U))).sum().astype(np.int64))
            order = np.argsort(columns[0], kind="stable").astype(np.int32)
            own = np.flatnonzero(np.append(True, np.diff(columns[0][order]) != 0))
            rows: list[tuple[int, bytes]] = []
            for i, part in enumerate(np.split(order, own[1:])):
                rows.append((int(columns[0][part[0]]), _packed(*(c[part] for c in columns[1:]), block, None if i else names)))
                if sum(len(r[1]) for r in rows) > SENT_BYTES or i == len(own) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([False] * len(rows)), pa.array([r[1] for r in rows], pa.binary())], ["shard", "counts", "data"])
                    rows.clear()

        for batch, texts in chunks(batches):
            if not texts.n:
                continue
            keys.append(batch.column("doc").to_numpy())
            for to, c in zip(held, tokens(texts, keys[-1])):
                to.append(c)
            n_docs += texts.n
            if sum(map(len, held[0])) > HELD_TOKENS:
                yield from sent()
                n_docs = 0
        if keys:
            yield from sent()

    return _keyed_docs(docs).mapInArrow(run, TOKENS)


def _name(group: np.ndarray, before: np.ndarray, before2: np.ndarray, out: np.ndarray) -> np.ndarray:
    group, before, before2, out = (x.astype(U) for x in (group, before - START, before2 - START, out))
    return mix((before << U(32) | out) ^ mix(before2 << U(20) ^ group))


def _summed_ngrams(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """group, before, before2, out, n: each n-gram once."""
    *columns, n = (np.concatenate(x) for x in zip(*held))
    _, one, which = np.unique(_name(*(c.astype(np.int64) for c in columns)), return_index=True, return_inverse=True)
    return *(c[one] for c in columns), np.bincount(which, n, len(one)).astype(np.int64)


def _pressed(columns: tuple[np.ndarray, ...]) -> bytes:
    order = np.argsort(_paired(columns[1], columns[3]))
    *columns, n = (c[order] for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*map(_planes, columns), n.astype(np.int64).tobytes()]))


def _loose(data: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = len(data) // 24
    return *(_of_planes(data, n, 4 * n * i) for i in range(4)), np.frombuffer(data, np.int64, n, 16 * n)


def _shared_counts(learn: DataFrame, model: Model, shards: int, pairs: Hot) -> DataFrame:
    """The n-grams of the groups of hot pairs with their counts in all training texts, for each shard that has tokens of such a pair. The counts of
    a group are summed up in tasks, then in its home; from there they go to the pair's shards. Home has the tokens of the group's other pairs itself; elsewhere these are one word before, `REST`."""
    lexicon, hot = model.lexicon, pairs.hot
    shared = learn.sparkSession.sparkContext.broadcast((model, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            kind = _own(model, columns[1].astype(np.int64), columns[3])[0]
            home = _home(columns[1].astype(np.int64), kind, columns[0].astype(np.int64), shards)
            order = np.argsort(home, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(home[order]) != 0))
            rows = [(int(home[part[0]]), _pressed(tuple(c[part] for c in columns))) for part in np.split(order, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

        for _, texts in chunks(batches):
            seq = Sequence(texts, model.lexicon)
            names = _names(seq, model.lexicon)
            before, before2 = seq.before(names, 1, START), seq.before(names, 2, START)
            group = _group(before, before2, before, model.lexicon, hot)
            some = np.flatnonzero(_found(pairs.groups, _paired(before, group))[0])
            before, before2, group = before[some], before2[some], group[some]
            before2 = np.where(_found(pairs.pair, _paired(before, before2))[0], before2, REST)
            columns = (group, before, before2, _outputs(seq, model.lexicon)[some])
            held.append(_summed_ngrams([(*(c.astype(np.int32) for c in columns), np.ones(len(some), np.int64))]))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_summed_ngrams(held)]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield out(held.pop())
                    size = 0
        if size:
            yield out(_summed_ngrams(held))

    def add(group: pa.Table) -> pa.Table:
        model, pairs = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        for data in group["data"]:
            held.append(_loose(data.as_py()))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [_summed_ngrams(held)]
        columns = _summed_ngrams(held)
        home = group["shard"][0].as_py()
        part, before = (x.astype(np.int64) for x in columns[:2])
        kind = _own(model, before, columns[3])[0]
        real = columns[2] != REST
        rows = [(home, _pressed(tuple(c[real] for c in columns)))]
        times = _often(before, model.lexicon) // pairs.hot + 1
        parts = pairs.group_parts[_found(pairs.groups, _paired(before, part))[1]]
        unit = np.unique(np.stack([before * CLASSES + kind, part, times, parts]), axis=1, return_inverse=True)
        to: dict[int, list[int]] = {}
        for u, (context, part, times, parts) in enumerate(unit[0].T):
            near = (part + np.arange(1, parts)) % times
            for shard in np.unique(_home(np.full(len(near), context // CLASSES), context % CLASSES, near, shards)):
                if shard != home:
                    to.setdefault(int(shard), []).append(u)
        of = unit[1].ravel()
        order = np.argsort(of, kind="stable")
        lines = np.split(order, np.cumsum(np.bincount(of, minlength=unit[0].shape[1]))[:-1])
        for shard, units in to.items():
            some = np.concatenate([lines[u] for u in units])
            rows.append((shard, _pressed(tuple(c[some] for c in columns))))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "counts": pa.array([True] * len(rows)), "data": pa.array([r[1] for r in rows], pa.binary())})

    return learn.select("text").mapInArrow(run, "shard int, data binary").groupBy("shard").applyInArrow(add, TOKENS)


def _own(model: Model, before: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each output, and the log of its share of the class's own distribution."""
    n = len(model.lexicon.hash)
    symbol_of, share = model.outputs
    class_before = np.where(before < 0, END_CLASS, model.symbol_class[symbol_of[np.where(before < n, before, n + (before - n) % ENDINGS)]])
    return model.symbol_class[symbol_of[out]], model.by_class[class_before, symbol_of[out]] + share[out]


def ngram_weights(n: np.ndarray, own: np.ndarray, group: np.ndarray, steps: int = NGRAM_STEPS, variance: float = VARIANCE) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each n-gram, and the log of the normalising sum of each context. n: training counts; own: log shares without the weights; group: context, ascending.
    Steps along the gradient of the likelihood under the prior, scaled by its curvature."""
    total = np.bincount(group, n)
    share, weight = np.exp(own), np.zeros(len(n))
    some = np.flatnonzero(n > 0)
    s, g, k = share[some], group[some], n[some]
    w = np.zeros(len(some))
    for step in range(steps + 1):
        norm = 1 + np.bincount(g, s * np.expm1(w), len(total))
        if step < steps:
            expected = (total / norm)[g] * s * np.exp(w)
            w += np.clip((k - expected - w / variance) / (expected + 1 / variance), -LARGEST, LARGEST)
    weight[some] = w
    return weight, np.log(norm)


def _keyed(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each distinct pair of keys (the second below 2**32), in their order, and the first key of each number."""
    own, which = np.unique(keys[0].astype(np.int64) << 32 | keys[1], return_inverse=True)
    return which, own >> 32


def shard_scores(model: Model, group: np.ndarray, train: np.ndarray, before: np.ndarray, before2: np.ndarray, out: np.ndarray) -> np.ndarray:
    """log10 of P(word | class, the two words before) of each n-gram of a shard, after its weights are trained. train: how often it is in training texts.
    A word before shares no weight with another, so they are trained some at a time."""
    score, order = np.empty(len(before)), np.argsort(before, kind="stable").astype(np.int32)
    edges = np.flatnonzero(np.diff(before[order], append=-2)) + 1  # where the next word before begins
    at = 0
    while at < len(order):
        to = int(edges[min(np.searchsorted(edges, at + TRAINED), len(edges) - 1)])
        part = order[at:to]
        score[part] = _trained_scores(model, *(x[part].astype(np.int64) for x in (group, train, before, before2, out)))
        at = to
    return score


def _trained_scores(model: Model, group: np.ndarray, train: np.ndarray, before: np.ndarray, before2: np.ndarray, out: np.ndarray) -> np.ndarray:
    kind, own = _own(model, before, out)
    context, _ = _keyed(before - START, group * CLASSES + kind)
    pair, context_of = _keyed(context, out)
    weight, norm = ngram_weights(np.bincount(pair, train), _first(pair, own), context_of)
    one = own + weight[pair] - norm[context]
    del own, kind, pair
    context, _ = _keyed(context, before2 - START)
    pair, context_of = _keyed(context, out)
    weight, norm = ngram_weights(np.bincount(pair, train), _first(pair, one), context_of)
    return (one + weight[pair] - norm[context]) / np.log(10)


def _first(number: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each number: it is the same wherever the number stands."""
    out = np.empty(number.max() + 1 if len(number) else 0)
    out[number] = values
    return out


def _answer(block: int, doc: np.ndarray, score: np.ndarray, keys: np.ndarray) -> bytes:
    parts = [np.array([block, len(doc), len(keys)]).tobytes(), keys.tobytes(), _planes(np.diff(doc, prepend=0)), score.astype(np.float32).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _answered(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    block, n, named = (int(x) for x in np.frombuffer(data, np.int64, 3))
    at = 24 + 8 * named
    return block, np.cumsum(_of_planes(data, n, at)), np.frombuffer(data, np.float32, n, at + 4 * n), np.frombuffer(data, np.int64, named, 24)


def _within(docs: DataFrame, learn: DataFrame, model: Model, shards: int, hot: int, parts: int) -> DataFrame:
    """doc, within, rows: the sum of the second factor's log10, and how many rows have these values. learn: the training texts."""
    pairs = hot_pairs(learn, model.lexicon, hot)
    shared = docs.sparkSession.sparkContext.broadcast((model, pairs))

    def run(group: pa.Table) -> pa.Table:
        model, pairs = shared.value
        packs, seen = [], []
        for data, counts in zip(group["data"], group["counts"].to_pylist()):
            if counts:
                columns = _loose(data.as_py())
                seen.append((_name(*(c.astype(np.int64) for c in columns[:4])), columns[4], *columns[:4]))
                continue
            doc, *columns, block, keys = _unpacked(data.as_py())
            before, before2, out = (x.astype(np.int64) for x in columns)
            kind = _group(before, before2, doc, model.lexicon, hot)
            learnt = (doc & 1 == 1) & ~_found(pairs.pair, _paired(before, before2))[0]  # what a hot pair learns from is in the shared counts
            name, one, which = np.unique(_name(kind, before, before2, out), return_index=True, return_inverse=True)
            seen.append((name, np.bincount(which, learnt, len(one)).astype(np.int32), *(c[one].astype(np.int32) for c in (kind, before, before2, out))))
            packs.append((len(seen) - 1, doc >> 1, which.astype(np.int32), block, keys.copy()))
        ends = np.cumsum([len(x[0]) for x in seen])
        names, seen = np.concatenate([x[0] for x in seen]), [x[1:] for x in seen]
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        del names
        which = which.astype(np.int32)
        train = np.bincount(which, np.concatenate([x[0] for x in seen]))
        columns = [np.concatenate([x[i] for x in seen])[one] for i in range(1, 5)]
        del seen, one
        score = shard_scores(model, columns[0], train, *columns[1:])
        del columns, train
        rows = []
        for i, doc, own, block, keys in packs:
            each = score[which[ends[i - 1] if i else 0 : ends[i]][own]]
            some = np.flatnonzero(np.bincount(doc))
            rows.append((block % parts, _answer(block, some, np.bincount(doc, each)[some], keys)))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        named: dict[int, list[np.ndarray]] = {}
        for data in group["data"]:
            block, doc, score, keys = _answered(data.as_py())
            held.setdefault(block, []).append((doc, score))
            if len(keys):
                named.setdefault(block, []).append(keys)
        # blocks of the same documents in the same order have one hash: their sums are those of all
        sums = [np.bincount(np.concatenate([x[0] for x in held[b]]), np.concatenate([x[1] for x in held[b]]).astype(float), len(keys[0])) for b, keys in named.items()]
        rows = [np.full(len(keys[0]), len(keys)) for keys in named.values()]
        return pa.table({"doc": np.concatenate([k[0] for k in named.values()]), "within": np.concatenate(sums), "rows": np.concatenate(rows)})

    dealt = _dealt(docs, model, shards, hot, pairs)
    if len(pairs.pair):
        dealt = dealt.unionByName(_shared_counts(learn, model, shards, pairs))
    each = dealt.groupBy("shard").applyInArrow(run, "part int, data binary")
    sums = each.groupBy("part").applyInArrow(add, "doc long, within double, rows long")
    return sums.groupBy("doc").agg(F.sum("within").alias("within"), F.sum("rows").alias("rows"))


def scores(docs: DataFrame, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    learn = docs.where(~held_out(F.col("doc_id"))).select("text")
    vocab = written(vocabulary(learn), "vocabulary")
    model = fit(learn, vocab)
    lex = model.lexicon
    partial = written(_scored(docs, model), "scored")
    room = spark.createDataFrame(pa.table({"e": pa.array(np.arange(ENDINGS), pa.int32()), "room": lex.other_room}))  # Arrow: no Python workers of its own
    rest = partial.where("word is not null").select("doc", "word", "ending", "times")
    rest = rest.join(vocab.select("word", F.col("n").alias("c")), "word", "left").join(F.broadcast(room), F.col("ending") == F.col("e"))
    count = F.coalesce("c", F.lit(0))
    rest = rest.groupBy("doc").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * F.log10((count + 0.5) / (lex.tokens + 0.5 * (lex.distinct + 1)))).alias("b"),
        F.sum(F.col("times") * F.log10((count + 0.5) / F.col("room"))).alias("s"),
    )
    shards = int(lex.tokens * 1.25 / shard) + 1
    within = _within(docs, learn, model, shards, hot, shards // 4 + 1)
    # rows of the same values have one key: the sums of all of them are those of one so many times
    sums = within.join(rest, "doc", "left").select("doc", *((F.col(c) / F.col("rows")).alias(n) for c, n in (("within", "w"), ("k", "k"), ("b", "b"), ("s", "s"))))
    whole = partial.where("word is null").select("doc_id", "doc", "held_out", "n_tokens", "n_known", "base", "score")
    out = whole.join(sums, "doc", "left")
    add = lambda *c: sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.col(c[0]))
    return out.select("doc_id", "held_out", "n_tokens", add("n_known", "k").cast("long").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), add("base", "b").alias("base_score"), add("score", "w", "s").alias("score"))
