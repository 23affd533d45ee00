"""Nested timed transcripts as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafgate.functions.text import strip_ends


def transcript_lines(segments: DataFrame, key: str) -> DataFrame:
    """key, segment_no, word_no (0 is the segment's own line), line. segments: key, segment_no, start, end, text, words (may be null; a word's start too)."""
    head = F.format_string("\n[%.1fs — %.1fs]  %s", "start", "end", strip_ends(F.col("text")))
    word = lambda w: F.format_string("    %8s  %s", F.coalesce(F.format_string("%.2fs", w["start"]), F.lit("?")), w["word"])
    said = F.concat(F.array(head), F.transform(F.coalesce("words", F.array().cast("array<struct<start:double,word:string>>")), lambda w: F.when(w["start"].isNull(), F.format_string("    %8s  %s", F.lit("?"), w["word"])).otherwise(word(w))))
    return segments.select(key, "segment_no", F.posexplode(said).alias("word_no", "line"))


def transcript_texts(lines: DataFrame, key: str) -> DataFrame:
    """key, text: the lines of a key in order, joined by line feeds."""
    return lines.groupBy(key).agg(F.expr("listagg(line, '\\n') within group (order by segment_no, word_no)").alias("text"))


def preview(lines: DataFrame, key: str, n: int = 35) -> DataFrame:
    """The first lines, a top-k by place."""
    return lines.orderBy(key, "segment_no", "word_no").limit(n)
