"""Chunks made in pieces equal those of whole chapters."""

import random

import pytest
from pyspark.sql import functions as F

from leafgate.functions.text import clean
from leafgate.operators import chapters as ch, chunks, lines as ln, pieces

WORDS = ["a", "bb", "Ccc.", "d!", "HELLO", "NASA", "12", "e?", "end-", "\x07f.", "g\t h", "É.", "x.y"]


def book(seed, pages):
    rng = random.Random(seed)
    out = []
    for i in range(pages):
        rows = []
        for _ in range(rng.randint(0, 12)):
            rows.append(rng.choice(["", "  ", "42", " 7 ", "Chapter " + str(rng.randint(1, 9)) + f" p{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))] if rng.random() < 0.5 else [f"Sentence {rng.random():.3f} goes on. And ends."]))
        out.append("\n".join(rows) if rng.random() < 0.95 else None)
    return out


@pytest.mark.parametrize("seed, most, size", [(1, 5, 40), (2, 12, 200), (3, 200, 1000), (4, 1, 1), (5, 30, 10**9)])
def test_pieces_equal_whole_chapters(spark, seed, most, size):
    rows = [(b, i, t) for b, n in (("one", 60), ("two", 9), ("none", 1)) for i, t in enumerate(book(seed * 10 + n, n))]
    rows += [("flat", i, f"No heading {i} here\nand a line. \nIt goes on.\nNew line {i}.\nLast {i}") for i in range(40)] + [("digits", 0, "7\n8\n"), ("empty", 0, "")]
    found = ln.strip_repeated(ln.lines(spark.createDataFrame(rows, "book_id string, page_no int, text string")))
    whole = chunks.chunked(ch.chapters(found).withColumn("text", clean(F.col("text"))), chunks.by_words(F.col("text"), most))
    want = sorted(map(tuple, whole.select("book_id", "chapter_no", "chunk_no", "chunk").collect()))
    got = sorted(map(tuple, pieces.chunked_by_words(found, most, size).collect()))
    assert got == want
    if size < 1000:
        assert pieces.pieces(found, size).where("book_id = 'flat'").count() > 5  # a book without headings is no single string


def test_tables_of_pieces_follow_every_state():
    rng = random.Random(9)
    for _ in range(300):
        most, sizes = rng.randint(1, 9), [rng.randint(0, 12) for _ in range(rng.randint(0, 9))]
        opened, after = pieces._table(sizes, most)
        for state in range(most + 2):
            end, n = pieces._alone(sizes, state, most)
            assert (n, min(end, most + 1)) == (opened[state], after[state])


def test_no_rows(spark):
    none = spark.createDataFrame([], "book_id string, page_no int, text string")
    assert pieces.chunked_by_words(ln.strip_repeated(ln.lines(none))).collect() == []


def test_lines_are_cleaned_and_cut_once(spark):
    found = ln.strip_repeated(ln.lines(spark.createDataFrame([("one", i, t) for i, t in enumerate(book(3, 20))], "book_id string, page_no int, text string")))
    plan = pieces.chunked_by_words(found, 9, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "posexplode" not in plan.lower()  # the result begins at the written pieces
