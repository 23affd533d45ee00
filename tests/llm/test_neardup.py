import bisect
import random
import re

import numpy as np

import pytest

from leafgate.llm import neardup
from leafgate.llm.neardup import classes, components, deduplicated, similarity
from tests.llm.conftest import rows


def test_similarity():
    a = np.arange(100, dtype=np.uint64)
    assert similarity(a, a) == 1
    assert similarity(a, a[:0]) == 0
    b = a.copy()
    b[40:45] += np.uint64(1000)
    assert abs(similarity(a, b) - 95 / 105) < 1e-9
    assert similarity(a, np.concatenate([a[50:], a[:50]])) < 0.8  # the same labels in another order
    assert similarity(a, np.concatenate([a[:10], a[12:11:-1], a[10:11], a[13:]])) > 0.9


def changed(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"new{rng.random()}"
    return words


def test_classes_of_planted_copies(make):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    docs, want = [], {}
    for g in range(12):  # a text and copies with a few changed words: shingle similarity of 0.85 or more
        base = fresh(rng.choice([60, 200, 500]))
        for j in range(5):
            i = g * 10 + j
            docs.append((i, " ".join(base if j == 0 else changed(rng, base, len(base) // 100 + (len(base) > 100)))))
            want[i] = g * 10
    for j in range(40):  # others alone
        docs.append((1000 + j, " ".join(fresh(80))))
        want[1000 + j] = 1000 + j
    half = fresh(100)
    docs += [(2000, " ".join(half + fresh(100))), (2001, " ".join(half + fresh(100)))]  # half in common is not enough
    docs += [(3001, "one two"), (3000, "one two"), (3002, "one three"), (3003, None), (3004, None), (3005, " \n"), (3006, " \n"), (3007, "Exact Copy"), (3007, "Exact Copy")]
    want |= {2000: 2000, 2001: 2001, 3001: 3000, 3000: 3000, 3002: 3002, 3003: 3003, 3004: 3004, 3005: 3005, 3006: 3006, 3007: 3007}
    docs.append((None, "one two"))
    frame = make(*docs)
    got = rows(classes(frame), "doc_id", "class_id")
    assert {i: c for i, c in got if i is not None} == want and (None, None) in got and len(got) == len(docs)
    kept = [r[0] for r in rows(deduplicated(frame), "doc_id")]
    assert sorted({k for k in kept if k is not None}) == sorted(set(want.values())) and None in kept


@pytest.mark.parametrize("together", [500, 150])  # in one block, and in many
def test_pairs_on_one_template(make, monkeypatch, together):
    """All texts share sketches with all others, and each is like its partner alone."""
    monkeypatch.setattr(neardup, "TOGETHER", together)
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = fresh(340), []
    for i in range(200):
        own = fresh(60)
        docs += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:18] + fresh(42)))]
    label = [neardup.labels(neardup.Words(neardup.texts_of(neardup.pa.array([t])), neardup.NON_SPACE))[0] for _, t in docs]
    assert all(similarity(label[i], label[i + 1]) >= 0.8 for i in range(0, 400, 2))
    assert all(similarity(label[0], x) < 0.8 for x in label[2:])
    assert rows(classes(make(*docs)), "doc_id", "class_id") == [(i, i - i % 2) for i in range(400)]


def test_components_of_a_chain_and_empty_tables(spark, make):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 15] + [(5, 5)], "id long, leader long")
    got = dict(rows(components(edges), "id", "class"))
    assert got == {i: 0 if i <= 15 else 16 for i in range(1, 31) if i != 16}
    assert classes(make((1, "a")).limit(0)).count() == 0
    assert rows(classes(make((1, "a b c d e f"), (2, "g h i j k l"))), "doc_id", "class_id", "n_in_class", "kept") == [(1, 1, 1, True), (2, 2, 1, True)]


def brute(docs, threshold=0.8):
    """Classes by all pairs of texts: k-mers with the number of equal ones before, the longest common subsequence of them."""
    names: dict[tuple, int] = {}
    labels = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen: dict[tuple, int] = {}
        own = []
        for p in range(max(1, len(words) - 4) if words else 0):
            k = tuple(words[p : p + 5])
            seen[k] = seen.get(k, 0) + 1
            own.append(names.setdefault((k, seen[k]), len(names)))
        labels.setdefault(i, own)
    of = {i: i for i in labels}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(labels)
    sets = {i: set(labels[i]) for i in ids}
    n_links = 0
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if not labels[i] or not labels[j] or len(sets[i] & sets[j]) < threshold * max(len(sets[i]), len(sets[j])) - 1e-9:
                continue
            place = {k: p for p, k in enumerate(labels[j])}
            tails: list[int] = []
            for p in (place[k] for k in labels[i] if k in place):
                at = bisect.bisect_left(tails, p)
                tails[at : at + 1] = [p]
            if len(tails) >= threshold * (len(labels[i]) + len(labels[j]) - len(tails)) - 1e-9:
                n_links += 1
                a, b = sorted((top(i), top(j)))
                of[b] = a
    return {i: top(i) for i in ids}, n_links


def test_classes_equal_all_pairs_on_the_drivers_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, n = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n > 10
    assert dict(rows(classes(docs), "doc_id", "class_id")) == want


@pytest.mark.parametrize("kind", ["template", "chain", "moved"])
def test_classes_equal_all_pairs_on_made_groups(make, kind):
    """Two hundred texts on one template with their own parts of all sizes; chains of small changes; parts that change places."""
    rng = random.Random(len(kind))
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = fresh(300), []
    last = template
    for i in range(200):
        if kind == "template":
            words = template + fresh(rng.randrange(10, 160))
        elif kind == "chain":
            last = words = changed(rng, last if i % 20 else fresh(300), rng.randrange(3, 12))
        else:
            cut = rng.randrange(40, 260)
            words = template[cut:] + template[:cut] + fresh(rng.randrange(60))
        docs.append((i, " ".join(words)))
    want, n = brute(docs)
    got = dict(rows(classes(make(*docs)), "doc_id", "class_id"))
    assert n > 20 and got == want


def test_very_long_texts_and_ties(make):
    rng = random.Random(15)
    words = [f"w{rng.randrange(3000)}" for _ in range(30_000)]
    docs = [(5, " ".join(words)), (3, " ".join(words[:27_000])), (4, " ".join(words[:9_000])), (6, "a " * 20_000), (7, "a " * 18_000), (8, "a " * 9)]
    assert dict(rows(classes(make(*docs)), "doc_id", "class_id")) == brute(docs)[0]
