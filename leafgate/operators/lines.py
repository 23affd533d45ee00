"""Pages to lines; lines that repeat over many pages of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafgate.functions.text import is_heading, split_lines, strip_ends, text_or_empty

MIN_PAGES = 5


def lines(pages: DataFrame) -> DataFrame:
    """book_id, page_no, line_no, line, stripped. pages: book_id, page_no, text (null is empty)."""
    out = pages.select("book_id", "page_no", F.posexplode(split_lines(text_or_empty("text"))).alias("line_no", "line"))
    return out.withColumn("stripped", strip_ends(F.col("line")))


def repeated_lines(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """book_id, stripped, n_pages of non-blank lines on so many pages of a book. Counted per page first, so it combines before the shuffle."""
    once = rows.where("stripped <> ''").select("book_id", "page_no", "stripped").distinct()
    return once.groupBy("book_id", "stripped").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def repeated_of_pages(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same of pages, of which each is one row: a page's lines are made distinct within the row, so only counts travel."""
    own = F.array_distinct(F.transform(split_lines(text_or_empty("text")), strip_ends))
    once = pages.select("book_id", F.explode(own).alias("stripped")).where("stripped <> ''")
    return once.groupBy("book_id", "stripped").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def strip_repeated(rows: DataFrame, min_pages: int = MIN_PAGES, keep_headings: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """rows without repeated lines. keep_headings: headings stay even if they repeat (not the default). repeated: those lines, where they are known."""
    repeated = (repeated_lines(rows, min_pages) if repeated is None else repeated).select("book_id", "stripped")
    if keep_headings:
        repeated = repeated.where(~is_heading(F.col("stripped")))
    return rows.join(repeated, ["book_id", "stripped"], "left_anti").select(*rows.columns)
