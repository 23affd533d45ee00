import hashlib
import random
import re

import numpy as np
import pytest

from leafgate.llm import substring, suffixes
from leafgate.llm.textarrays import Texts
from tests.llm.conftest import rows

LAST = 1 << 63


def brute_words(docs):
    low, out = {}, []
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            low[key] = min(low.get(key, LAST), LAST if i is None else i)
    for i, w in split:
        gone = set()
        for p in range(len(w) - 12):
            if low[tuple(w[p : p + 13])] < (LAST if i is None else i):
                gone |= set(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def brute_bytes(docs):
    low, out = {}, []
    order = [(LAST if i is None else i, i, (t or "").encode()) for i, t in docs]
    for rank, _, b in order:
        for p in range(len(b) - 99):
            key = b[p : p + 100]
            low[key] = min(low.get(key, (rank, p)), (rank, p))
    for rank, i, b in order:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if low[b[p : p + 100]] < (rank, p):
                gone[p : p + 100] = b"\x01" * 100
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def given(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "é", "the", "Ω1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(60)
    docs = []
    for i in range(24):
        kind = i % 4
        docs.append((rng.randrange(200), [text(rng.randrange(40)), text(8) + "\n" + shared + " " + text(5), shared[rng.randrange(80) :], text(20) + " " + shared[:150] * 2][kind]))
    same = text(30)
    return [*docs, (7, None), (8, ""), (9, "a " * 700), (500, same), (500, same), (None, shared), (501, " \t" + shared)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(make, seed):
    docs = given(seed)
    got = rows(substring.substring_dedup(make(*docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(docs)


@pytest.mark.parametrize("far", [False, True])  # in one slice, and only meeting in a bucket
def test_spacing_between_words_does_not_matter(make, monkeypatch, far):
    if far:
        monkeypatch.setattr(substring, "SLICE", 1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i + 1, "start%d " % i + gap.join(words) + " end%d" % i) for i, gap in enumerate([" ", "\r\n", " ", "  ", "\n\n", "\t"])]
    got = rows(substring.substring_dedup(make(*docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(docs)
    assert [r[2] for r in got] == [0, 30, 30, 30, 30, 30]


def test_windows_of_one_hash_are_told_apart_by_the_proof():
    hashes, owner = np.full(4, 7, np.uint64), np.array([1, 2, 3, 4])
    proof = np.array([[5, 6, 5, 6]], np.uint64)
    assert substring.least_owner(hashes, owner, proof).tolist() == [1, 2, 1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(make, seed):
    docs = given(seed)
    got = rows(suffixes.suffix_dedup(make(*docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(docs)


def test_empty_tables(make):
    assert substring.substring_dedup(make((1, "a")).limit(0)).count() == 0
    assert suffixes.suffix_dedup(make((1, "a")).limit(0)).count() == 0


def test_every_pair_of_remainders_meets_in_the_cover():
    p, cover = suffixes.PERIOD, suffixes.COVER
    for a in range(p):
        for b in range(p):
            assert any((a + d) % p in cover and (b + d) % p in cover for d in range(p))


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh é", "a\x00b"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_are_in_suffix_order(monkeypatch, alphabet, seed):
    """The blocks, one after another, are the sorted suffixes; equal neighbours are found."""
    monkeypatch.setattr(suffixes, "SORTED", 64)
    rng = random.Random(seed)
    shared = "".join(rng.choice(alphabet) for _ in range(150))
    pieces = []
    for i in range(20):
        own = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        pieces.append((own + shared[rng.randrange(60) :] + own[: rng.randrange(9)] * 3).encode())
    pieces += [pieces[3], pieces[4][5:]]
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    offs = np.append(0, np.cumsum([len(p) for p in pieces]))
    anchor = np.array([rng.randrange(len(p)) for p in pieces])  # any anchors: suffixes of all residues tie
    blocks = list(suffixes.suffix_blocks(Texts(buf, offs), anchor))
    assert len(blocks) > 1 or alphabet == "a"
    said = [(pieces[p][k:], int(offs[p]) + k) for p in range(len(pieces)) for k in range(len(pieces[p]) - 99)]
    text = {at: t for t, at in said}
    got = [int(x) for at, _ in blocks for x in at]
    assert sorted(got) == sorted(text)
    assert [text[x] for x in got] == sorted(text.values())
    for at, same in blocks:
        assert same.tolist() == [False] + [text[int(x)][:100] == text[int(y)][:100] for x, y in zip(at, at[1:])]
    first = {}
    for t, at in sorted(said, key=lambda x: x[1]):
        first.setdefault(t[:100], at)
    later, leads = suffixes.first_equal(Texts(buf, offs), anchor)
    assert dict(zip(later.tolist(), leads.tolist())) == {at: first[t[:100]] for t, at in said if first[t[:100]] != at}


@pytest.mark.parametrize("salts", [1, 3])
def test_hot_strings_are_combined_on_their_way(make, monkeypatch, salts):
    """Widely shared passages over many small packs: the result is the same, and a bucket gets few of their strings."""
    monkeypatch.setattr(substring, "HELD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "HELD_BYTES", 2000)
    monkeypatch.setattr(substring, "SLICE", 15_000)
    monkeypatch.setattr(suffixes, "SLICE", 15_000)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    hot = " ".join(word() for _ in range(60))
    docs = [(rng.randrange(1000), f"{word()} {word()} {hot if i % 3 else hot[100:]} {word()}") for i in range(120)] + [(None, hot), (5, None)]
    assert len(substring.widely_shared(make(*docs), substring._runs).hashes) > 40  # so there are hot ones
    got = rows(substring.substring_dedup(make(*docs), salts=salts), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(docs)
    got = rows(suffixes.suffix_dedup(make(*docs), salts=salts), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(docs)


def test_very_long_texts(make):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:30_000])), (3, "x " * 100_000)]
    assert rows(substring.substring_dedup(make(*docs)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(docs)
    assert rows(suffixes.suffix_dedup(make(*docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(docs)


def test_rows_without_an_id_whose_short_hashes_collide_are_told_apart(make, spark):
    """Two rows without a doc_id, one with a passage of document 1 and one without, that 32 bits of hash could not tell apart."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(30))
    other = " ".join(f"q{i}" for i in range(30))
    made = spark.range(400_000).select(F.concat(F.when(F.col("id") % 2 == 0, passage).otherwise(other), F.lit(" n"), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).alias("kind"))
    hashed = made.withColumn("h", F.hash(F.lit(None).cast("long"), "text"))
    pair = hashed.groupBy("h").agg(F.min_by("text", "kind").alias("a"), F.max_by("text", "kind").alias("b"), F.count_distinct("kind").alias("n")).where("n = 2").first()
    docs = [(1, passage), (None, pair["a"]), (None, pair["b"]), *[(2, other + " twice")] * 40, *[(None, None)] * 3]
    for run, brute, columns in (
        (substring.substring_dedup, brute_words, ("doc_id", "n_words", "n_removed", "kept_sha256")),
        (suffixes.suffix_dedup, brute_bytes, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    ):
        got = rows(run(make(*docs).repartition(3)), *columns)
        want = brute(docs)
        if brute is brute_bytes:  # rows of one document that start at one place are one
            assert [r[:3] for r in got] == [r[:3] for r in want]
        assert got == want
