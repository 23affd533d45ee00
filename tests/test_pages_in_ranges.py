"""Chunks of pages that are dealt to tasks by ranges: chapters, sentences and chunks that pass from task to task."""

import pytest
from pyspark.sql import functions as F

from leafgate.functions.text import clean
from leafgate.operators import chapters as ch, chunks, lines as ln, pieces
from tests.test_pieces import book

PAGES = "book_id string, page_no int, text string"


def wanted(found, most):
    whole = chunks.chunked(ch.chapters(found).withColumn("text", clean(F.col("text"))), chunks.by_words(F.col("text"), most))
    return sorted(map(tuple, whole.select("book_id", "chapter_no", "chunk_no", "chunk").collect()))


@pytest.fixture
def tasks(spark):
    """Sets the number of tasks that pages are dealt to."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": None}
    before = {k: spark.conf.get(k) for k in names}

    def held(n):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", n)

    yield held
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, most, size, block, n", [(1, 5, 40, 100, 37), (2, 12, 200, 1, 5), (3, 200, 1000, 5000, 11), (4, 1, 1, 1, 61), (5, 30, 10**9, 10**9, 23)])
def test_ranges_of_pages_equal_whole_chapters(spark, tasks, seed, most, size, block, n):
    rows = [(b, i, t) for b, m in (("one", 60), ("two", 9), ("none", 1)) for i, t in enumerate(book(seed * 10 + m, m))]
    rows += [("flat", i, f"No heading {i} here\nand a line. \nIt goes on.\nNew line {i}.\nLast {i}") for i in range(40)]  # goes through many tasks
    rows += [("no place", i, f"goes on and {i}") for i in range(9)] + [("blank", i, " \n") for i in range(7)] + [("ends", 0, "A b.\nChapter 2"), ("ends", 1, None), ("ends", 2, "Chapter 3"), ("ends", 3, "c"), ("digits", 0, "7\n8\n"), ("empty", 0, "")]
    rows += [("repeated", i, f"Running head\nText {i} of it.\n  \nRunning head \n" + ("Chapter 9\n" if i % 2 else "")) for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    found = ln.strip_repeated(ln.lines(pages))
    want = wanted(found, most)
    tasks(n)
    assert sorted(map(tuple, pieces.chunked_pages_by_words(pages, most, size, block).collect())) == want
    assert sorted(map(tuple, pieces.chunked_by_words(found, most, size, block).collect())) == want
    parts = {r["part"] for r in pieces.pieces(found, size).select("part").distinct().collect()}
    assert len(parts) > min(n, 9) / 2  # more than one task had a share


def test_pages_with_one_number_are_one_page(spark, tasks):
    pages = spark.createDataFrame([("a", 1, "x y.\nSame\nA b."), ("a", 1, "Second c.\nSame"), ("a", 2, "Same\nLast.")] + [("a", i, f"Same\nt {i}.") for i in range(3, 6)], PAGES)
    want = wanted(ln.strip_repeated(ln.lines(pages), repeated=ln.repeated_of_pages(pages)), 3)
    tasks(3)
    assert want and sorted(map(tuple, pieces.chunked_pages_by_words(pages, 3, 1).collect())) == want


def test_text_travels_once(spark):
    """Before, lines, leaves, pieces and chunks each went through a shuffle of their own."""
    pages = spark.createDataFrame([("a", i, f"t {i}.") for i in range(9)], PAGES)
    plan = pieces._of_pages(pages, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning(book_id" in plan  # pages, and keys of repeated lines
    assert plan.index("Exchange rangepartitioning") < plan.index("Exchange hashpartitioning")  # nothing is dealt again after the pages are in ranges
    assert "Join" not in pieces._raw(pieces._of_rows(ln.lines(pages)), 9)._jdf.queryExecution().executedPlan().toString()
    final = pieces.chunked_pages_by_words(pages, 9, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in final and "explode" not in final.lower()
