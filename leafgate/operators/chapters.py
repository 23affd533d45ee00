"""Lines to chapters: a new one at each heading.

The running count of headings is found on two levels, pages of a book and lines of a page, so no task
needs all lines of a book in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from leafgate.functions.text import is_heading

FRONT = "Front Matter"


def headings(rows: DataFrame) -> DataFrame:
    return rows.where(is_heading(F.col("stripped")))


def segmented(rows: DataFrame) -> DataFrame:
    """rows with heading (boolean) and segment: headings up to and with the line, in its book."""
    rows = rows.withColumn("heading", is_heading(F.col("stripped")))
    pages = rows.groupBy("book_id", "page_no").agg(F.count_if("heading").alias("n"))
    earlier = Window.partitionBy("book_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    before = pages.select("book_id", "page_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    in_page = Window.partitionBy("book_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("in_page", F.sum(F.col("heading").cast("long")).over(in_page))
    return counted.join(before, ["book_id", "page_no"]).withColumn("segment", F.col("before") + F.col("in_page")).drop("before", "in_page")


def chapters(rows: DataFrame) -> DataFrame:
    """book_id, chapter_no, title, text. Each body line ends with a line feed; a chapter with a blank body goes, its title too."""
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("page_no", "line_no", "line"))))
    by = segmented(rows).groupBy("book_id", "segment").agg(
        F.coalesce(F.max(F.when(F.col("heading"), F.col("stripped"))), F.lit(FRONT)).alias("title"),
        F.array_join(F.transform(body, lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"),
        F.count_if(~F.col("heading") & (F.col("stripped") != "")).alias("filled"),
    )
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("segment"))
    return by.where("filled > 0").select("book_id", number.alias("chapter_no"), "title", "text")
