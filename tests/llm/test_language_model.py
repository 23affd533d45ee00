"""The language model against a slow version with dictionaries; what it learns; edge cases."""

import functools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafgate.llm import maxent
from leafgate.llm.maxent import CLASSES, ENDINGS, SYMBOLS
from leafgate.llm.textarrays import texts_of
from tests.llm.conftest import rows


def corpus(n=40, seed=1):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    follow = {w: rng.sample(names, 4) for w in names}
    docs = []
    for i in range(n):
        w = rng.choice(names)
        said = []
        for _ in range(rng.randint(1, 60)):
            said.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(names)
        docs.append((i, " ".join(said).capitalize()))
    return docs


class Slow:
    """P(word | class, two words before) by counting n-grams of words in dictionaries, a context at a time."""

    def __init__(self, model, docs, hot):
        self.model, self.lexicon, self.hot = model, model.lexicon, hot
        self.counts = [defaultdict(Counter), defaultdict(Counter)]
        self.weights = [{}, {}]
        for i, text in docs:
            if maxent_held_out(i):
                continue
            for context, context2, out in self.tokens(i, text):
                self.counts[0][context][out] += 1
                self.counts[1][context2][out] += 1
        for order in (0, 1):
            for context, outs in self.counts[order].items():
                self.weights[order][context] = self.trained(context, outs, order)

    def tokens(self, i, text):
        seq = maxent.Sequence(texts_of(pa.array([text])), self.lexicon)
        names, outs = maxent._names(seq, self.lexicon), maxent._outputs(seq, self.lexicon)
        doc = key_of[i, text]
        for k in range(len(outs)):
            before, before2 = (int(names[k - d]) if k >= d else -1 for d in (1, 2))
            group = int(maxent._group(*(np.array([x]) for x in (before, before2, doc)), self.lexicon, self.hot)[0])
            context = (before, group, int(self.model.symbol_class[seq.symbol[k]]))
            yield context, (*context, before2), int(outs[k])

    @functools.cache
    def share(self, context, out):
        return float(maxent._own(self.model, np.array([context[0]]), np.array([out]))[1][0])

    @functools.cache
    def norm(self, context):
        return math.log(1 + sum(math.exp(self.share(context, o)) * math.expm1(x) for o, x in self.weights[0].get(context, {}).items()))

    def one(self, context, out):
        context = context[:3]
        return self.share(context, out) + self.weights[0].get(context, {}).get(out, 0) - self.norm(context)

    @functools.cache
    def norm2(self, context2):
        return math.log(1 + sum(math.exp(self.one(context2, o)) * math.expm1(x) for o, x in self.weights[1].get(context2, {}).items()))

    def log(self, context2, out):
        return self.one(context2, out) + self.weights[1].get(context2, {}).get(out, 0) - self.norm2(context2)

    def trained(self, context, outs, order):
        base = {o: math.exp((self.one if order else self.share)(context, o)) for o in outs}
        w, total = dict.fromkeys(outs, 0.0), sum(outs.values())
        for _ in range(maxent.NGRAM_STEPS):
            norm = 1 + sum(base[o] * math.expm1(x) for o, x in w.items())
            for o in w:
                expected = total / norm * base[o] * math.exp(w[o])
                step = (outs[o] - expected - w[o] / maxent.VARIANCE) / (expected + 1 / maxent.VARIANCE)
                w[o] += min(maxent.LARGEST, max(-maxent.LARGEST, step))
        return w


def maxent_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 1


key_of: dict = {}


def fitted(make, docs):
    frame = make(*docs)
    learn = frame.where(~maxent.held_out(frame.doc_id)).select("text")
    for r in maxent._keyed_docs(frame).collect():
        key_of[r["doc_id"], r["text"]] = r["doc"]
    return frame, maxent.fit(learn, maxent.vocabulary(learn).cache())


@pytest.mark.parametrize("hot, known", [(10**9, 500_000), (5, 500_000), (10**9, 30)])
def test_scores_equal_the_slow_version(make, monkeypatch, hot, known):
    monkeypatch.setattr(maxent.lexicon_of, "__defaults__", (known,))
    docs = corpus()
    if known == 30:  # more words than there are symbols, so many are beyond the lexicon
        rng = random.Random(7)
        docs = [(i, t + " " + " ".join(rng.choice(["und", "et", f"r{rng.randrange(20_000)}"]) for _ in range(180))) for i, t in docs]
    frame, model = fitted(make, docs)
    slow, lexicon = Slow(model, docs, hot), model.lexicon
    assert known != 30 or len(lexicon.hash) < 3200
    counts = Counter(w for i, t in docs if not maxent_held_out(i) for w in t.lower().split())
    got = {r["doc_id"]: r["score"] for r in maxent.scores(frame, shard=500, hot=hot).collect()}
    for i, text in docs:
        seq = maxent.Sequence(texts_of(pa.array([text])), lexicon)
        c = model.symbol_class[seq.symbol]
        before = [seq.before(c, k, maxent.END_CLASS) for k in (1, 2, 3)]
        want = float(model.by_context[(before[0] * CLASSES + before[1]) * CLASSES + before[2], c].sum())
        want += sum(slow.log(context, out) for _, context, out in slow.tokens(i, text)) / math.log(10)
        for k, w in enumerate(text.lower().split()):
            if seq.place[k] < 0:
                want += math.log10((counts[w] + 0.5) / lexicon.other_room[seq.ending[k]])
        assert abs(got[i] - want) < 1e-3, (i, got[i], want)


def test_probabilities_of_all_outputs_add_up_to_one(make):
    docs = corpus()
    _, model = fitted(make, docs)
    slow, lexicon = Slow(model, docs, 5), model.lexicon
    assert np.allclose((10.0**model.by_context).sum(1), 1, atol=1e-4)
    outs = np.arange(len(lexicon.hash) + ENDINGS)
    contexts = {c2 for i, t in docs[:6] for _, c2, _ in slow.tokens(i, t)}
    kind, _ = maxent._own(model, np.full(len(outs), -1), outs)
    for context in list(contexts)[:25]:
        total = sum(math.exp(slow.log(context, int(o))) for o in outs[kind == context[2]])
        assert abs(total - 1) < 1e-4
    assert (lexicon.other_room >= 0.5 - 1e-9).all()


def test_held_out_texts_score_above_the_base_and_repeated_texts_above_others(make):
    docs = corpus(300)
    held = [i for i, _ in docs if maxent_held_out(i)]
    rng = random.Random(3)
    odd = [" ".join("".join(rng.choice("hijklmn") for _ in range(6)) for _ in range(40)) for _ in range(60)]
    free = [i for i in range(1000, 2000) if not maxent_held_out(i)]
    docs += [(free[k], t) for k, t in enumerate(odd)] + [(free[100 + k], t) for k, t in enumerate(odd[:30])]
    out = {r["doc_id"]: r for r in maxent.scores(make(*docs)).collect()}
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held) * 0.95
    each = [out[free[k]]["score"] / out[free[k]]["n_tokens"] for k in range(60)]
    assert min(each[:30]) > max(each[30:])  # the model has seen the first half twice


def test_the_result_does_not_depend_on_shards(make):
    docs = corpus()
    some, many = (rows(maxent.scores(make(*docs), shard=n), "doc_id", "score") for n in (10**9, 50))
    assert np.allclose([s for _, s in some], [s for _, s in many])


def test_no_shard_holds_a_phrase_of_all_texts(make):
    rng = random.Random(5)
    docs = [(i, "once upon a " + " ".join(f"w{rng.randrange(3000)}" for _ in range(5))) for i in range(20_000)]
    frame, model = fitted(make, docs)
    shards, size = int(model.lexicon.tokens * 1.25 / 4000) + 1, Counter()
    for r in maxent._dealt(frame, model, shards, 800).collect():
        size[r["shard"]] += len(maxent._unpacked(r["data"])[0])
    assert sum(size.values()) == 20_000 * 9
    assert max(size.values()) < 2 * 4000


def test_edge_cases(make):
    rng = random.Random(9)
    docs = [*corpus(30), (500, None), (501, ""), (502, " \n"), (503, "abc def"), (503, "abc def"), (None, "abc"), (504, " ".join(f"w{rng.randrange(99)}" for _ in range(30_000)))]
    out = maxent.scores(make(*docs)).collect()
    assert len(out) == len(docs) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert {r["n_tokens"] for i in (500, 501, 502) for r in by[i]} == {1} and len({r["score"] for r in by[503]}) == 1
    assert by[504][0]["n_tokens"] == 30_001 and not by[None][0]["held_out"]
    assert maxent.scores(make((1, "a")).limit(0)).count() == 0
    alone = maxent.scores(make((3, "one two one"), (3, None)).where("crc32(cast(doc_id as string)) % 5 = 1")).collect()
    untrained = [i for i in range(40) if maxent_held_out(i)][:3]
    alone = maxent.scores(make(*((i, "one two one") for i in untrained))).collect()
    assert [(r["n_known"], r["train_tokens"], r["n_tokens"]) for r in alone] == [(0, 0, 4)] * 3 and all(math.isfinite(r["score"]) for r in alone)
    assert SYMBOLS > ENDINGS


def test_a_hot_pair_learns_from_all_training_texts(make):
    docs = corpus(30)
    same = [(i, "once upon a time there was a king " + docs[3][1]) for i in range(1000, 1040)]
    other = [(i, "once upon a " + docs[i % 7][1]) for i in range(2000, 2040)]
    by = {r["doc_id"]: r["score"] for r in maxent.scores(make(*docs, *same, *other), shard=200, hot=5).collect()}
    each = [by[i] for i, _ in same]
    assert max(each) - min(each) < 1e-4  # one text has one score, whatever documents share its shard


def test_a_shard_trains_its_weights_for_some_words_at_a_time(make, monkeypatch):
    _, model = fitted(make, corpus())
    n, rng = 400_000, np.random.default_rng(2)
    grams = np.unique(np.stack([rng.integers(-1, x, n) for x in (200, len(model.lexicon.hash))] + [rng.integers(0, len(model.lexicon.hash), n)]), axis=1).astype(np.int32)
    before, before2, out = grams[:, rng.permutation(grams.shape[1])]
    group, train = np.zeros(len(out), np.int32), rng.integers(0, 3, len(out)).astype(float)
    both = []
    for trained in (10**9, 20_000):
        monkeypatch.setattr(maxent, "TRAINED", trained, raising=False)
        tracemalloc.start()
        both.append(maxent.shard_scores(model, group, train, before, before2, out))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert np.array_equal(*both)
    assert most < 50 * len(out), most / len(out)


def test_a_task_sends_packs_some_at_a_time(make, monkeypatch):
    monkeypatch.setattr(maxent, "SENT_BYTES", 10_000, raising=False)
    docs = corpus(600)
    frame, model = fitted(make, docs)
    run, keyed = [], maxent._keyed_docs(frame).toArrow().combine_chunks().to_batches()
    caught = type("Caught", (), {"mapInArrow": lambda self, f, _: run.append(f)})()
    monkeypatch.setattr(maxent, "_keyed_docs", lambda _: caught)
    maxent._dealt(frame, model, 40, 10**9, maxent.Hot(*[np.zeros(0, np.int64)] * 2, model.lexicon, 10**9))
    sent = [[(r["shard"], maxent._unpacked(r["data"]), len(r["data"])) for r in b.to_pylist()] for b in run[0](iter(keyed))]
    assert all(sum(x[2] for x in b[:-1]) <= 10_000 for b in sent) and len(sent) > 2
    assert sum(len(x[1][0]) for b in sent for x in b) == sum(len(t.split()) + 1 for _, t in docs)
    assert len({x[0] for b in sent for x in b}) == sum(map(len, sent)) and sum(len(x[1][5]) for b in sent for x in b) == len(docs)
