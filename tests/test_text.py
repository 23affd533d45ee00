import time

import pytest
from pyspark.sql import functions as F

from leafgate.functions import text as tx
from leafgate.operators import chunks


def one(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (tx.join_hyphens, "ab-\ncd é-\nà -\r\nx", "abcd éà -\r\nx"),
        (tx.join_hyphens, "a-\n12\nb", "a12\nb"),
        (tx.drop_numeric_lines, "a\n 12 \nb", "a\n\nb"),
        (tx.squeeze_blank_lines, "a\n\n\n\nb\n\nc", "a\n\nb\n\nc"),
        (tx.squeeze_spaces, "a \t b\nc", "a b\nc"),
        (tx.strip_controls, "a\x07\tb\r\n\x7fc", "a\tb\r\nc"),
        (tx.deshout, "THE NASA ACT of ÉCOLE A1B US mp3 LOUD_X", "The NASA Act of ÉCOLE A1B US mp3 LOUD_X"),
        (tx.strip_ends, " \t\na b\n ", "a b"),
        (tx.clean, " 1999 ", ""),
        (tx.clean, "a \x07 b", "a  b"),
    ],
)
def test_cleaning(spark, f, given, want):
    assert one(spark, f, given) == [want]


def test_lines_and_sentences(spark):
    assert one(spark, tx.split_lines, "", "a", "a\n", "a\r\nb\rc\x0bd e", "\n\n") == [[], ["a"], ["a"], ["a", "b", "c", "d", "e"], ["", ""]]
    assert one(spark, tx.split_sentences, "", "A b. C!  D?\nE") == [[""], ["A b.", "C!", "D?", "E"]]
    assert one(spark, tx.word_count, "", "  a b\tc\n") == [0, 3]


def test_headings(spark):
    yes = ["Chapter 1", "CHAPTER iv", "part two", "1. the", "Epilogue", "PREFACE", "Appendix B and more", "Part of me", "  Conclusion "]
    no = ["", "Conclusion.", "Part", "chapters", "the chapter 1", "1.x", "Chapter " + "x" * 73]
    assert one(spark, tx.is_heading, *yes) == [True] * len(yes)
    assert one(spark, tx.is_heading, *no) == [False] * len(no)
    assert one(spark, tx.is_heading, "Chapter " + "x" * 72) == [True]


def test_names(spark):
    f = lambda t: tx.safe_name(F.lit(100), t)
    assert one(spark, f, "A/B: c-d? é", "x" * 60) == ["100_AB c-d é.mp3", "100_" + "x" * 50 + ".mp3"]
    assert one(spark, tx.stem, "/a/b.c/d.e.txt", "d", ".x") == ["d.e", "d", ".x"]
    assert one(spark, lambda t: tx.with_suffix(t, ".z"), "/a.b/c.txt", "/a.b/c") == ["/a.b/c.z", "/a.b/c.z"]


def test_chunks(spark):
    assert one(spark, lambda t: chunks.by_chars(t, 10), "", "aa. bb. ccccccccccccc. d.") == [[], ["aa. bb.", "ccccccccccccc.", "d."]]
    assert one(spark, lambda t: chunks.by_words(t, 3), "", "a b. c. d e f g h. i.") == [[""], ["a b. c.", "d e f g h.", "i."]]
    assert one(spark, lambda t: chunks.by_words(t, 2), "a b. c d.") == [["a b.", "c d."]]


def test_ends_are_stripped_in_linear_time(spark):
    gap = " " * 400_000
    given = [f"a{gap}b", f" a{gap}b ", gap, f"{gap}a", f"a{gap}", "\u00a0a\u2003", ""]
    begun = time.monotonic()
    assert one(spark, tx.strip_ends, *given) == [f"a{gap}b", f"a{gap}b", "", "a", "a", "a", ""]
    assert time.monotonic() - begun < 30
