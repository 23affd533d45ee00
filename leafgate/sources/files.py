"""Sources and sinks over folders."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafgate.functions.text import stem
from leafgate.operators.manifest import stitched
from leafgate.operators.transcript import transcript_texts
from leafgate.sources.named import open_file, read_named, write_named

#: Characters and rows of pages that a task sends on at a time, about.
SENT_CHARS, SENT_ROWS = 4 << 20, 4096
PAGE = ["folder", "book_id", "page_no", "text"]


def _plain(path: Column) -> Column:
    """A file's path or name as it stands on disk: Spark's metadata has it encoded as a URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _folder(path: Column) -> Column:
    """Name of the folder that a file is in."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def _loaded(read: Callable[[], DataFrame], folder: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            raise FileNotFoundError(f"no folder {folder}") from e
        raise


def chapter_files(spark: SparkSession, folder: str, recursive: bool = False, piece_bytes: int | None = None) -> DataFrame:
    """path, book_id (the folder that a file is in), chapter_no (from 1, in the order of names), title, text of the *.txt files of a folder. None is an error.

    piece_bytes: a row for about so many bytes of a file instead, with piece (from 0), so that a file of any size is never held whole. The pieces of a file follow each
    other in order in one task; they are read by a path that executors share, or from a store that pyarrow opens."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive)
    names = _loaded(lambda: reader.load(folder), folder).select("path", _folder(F.col("path")).alias("book_id"))  # contents are not read
    names = names.withColumn("chapter_no", F.row_number().over(Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")))
    if names.isEmpty():
        raise FileNotFoundError(f"no .txt files in {folder}")
    names = names.withColumn("title", stem(F.col("path")))
    if piece_bytes is None:
        rows = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).text(folder, wholetext=True)
        rows = rows.select(_plain(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
        return rows.join(names, "path").select("path", "book_id", "chapter_no", "title", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with open_file(row.path) as file:
                    for i, text in enumerate(_texts(file, piece_bytes)):
                        yield pd.DataFrame([(*row, i, text)], columns=[*batch.columns, "piece", "text"])

    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism, "path")  # by a number that is set: few names would be one task's
    return dealt.mapInPandas(run, "path string, book_id string, chapter_no int, title string, piece long, text string")


def _texts(file: BinaryIO, step: int) -> Iterator[str]:
    """A file's text in pieces of about `step` bytes, cut between characters."""
    read = codecs.getincrementaldecoder("utf-8")("replace")
    text = read.decode(file.read(step))
    while block := file.read(step):
        yield text
        text = read.decode(block)
    yield text + read.decode(b"", True)


def digests(pieces: DataFrame) -> DataFrame:
    """path, book_id, chapter_no, title, digest (MD5 of the whole text) of chapter_files' pieces, without putting them together."""
    kept = ["path", "book_id", "chapter_no", "title"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, digest = None, hashlib.md5()
        for batch in batches:
            out = []
            for row in batch[[*kept, "text"]].itertuples(index=False):
                if of is not None and of[0] != row.path:
                    out.append((*of, digest.hexdigest()))
                    digest = hashlib.md5()
                of = row[:-1]
                digest.update(row.text.encode())
            yield pd.DataFrame(out, columns=[*kept, "digest"])
        if of is not None:
            yield pd.DataFrame([(*of, digest.hexdigest())], columns=[*kept, "digest"])

    return pieces.mapInPandas(run, "path string, book_id string, chapter_no int, title string, digest string")


def audio_files(spark: SparkSession, folder: str, pattern: str = "*.mp3", recursive: bool = False) -> DataFrame:
    """path, length of finished audio, by name; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return _loaded(lambda: reader.load(folder), folder).select("path", "length").orderBy("path")


def finished_outputs(spark: SparkSession, folder: str, pattern: str = "*.mp3") -> DataFrame:
    """book_id, fname of the audio in a folder of book folders: what manifest.pending takes as done."""
    return audio_files(spark, folder, pattern, recursive=True).select(_folder(F.col("path")).alias("book_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("fname"))


def stitched_folder(spark: SparkSession, folder: str, pattern: str = "*.mp3", numeric: bool = False) -> DataFrame:
    """The audio of one folder in the order of names, as one list, and the output beside the folder. None is an error."""
    found = audio_files(spark, folder, pattern)
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    at = F.regexp_extract("path", "^(.*)/", 1)
    return stitched(found.select(at.alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("fname")), "folder", numeric=numeric).withColumn("output", F.concat("folder", F.lit("_full.mp3")))


def _batched(pages: Iterable[str | None], folder: str, book: str) -> Iterator[pd.DataFrame]:
    """Rows of one file's pages, about SENT_CHARS at a time."""
    held: list[tuple[str, str, int, str]] = []
    size = 0
    for i, t in enumerate(pages, 1):
        held.append((folder, book, i, t or ""))
        size += len(held[-1][3])
        if size >= SENT_CHARS or len(held) >= SENT_ROWS:
            yield pd.DataFrame(held, columns=PAGE)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=PAGE)


def extracted_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], Iterable[str | None]] | Callable[[BinaryIO], Iterable[str | None]], pattern: str = "*.pdf", recursive: bool = False, opened: bool = False) -> DataFrame:
    """folder (that the file is in), book_id, page_no (from 1), text, by a caller's extractor of one file's pages. No extractor is built in.

    The extractor is given a file's bytes or, if opened, the file itself, open for reading from any place, so that a file of any size is never held whole: by a path that
    executors share, or of a store that pyarrow opens. Either way an extractor may give its pages one by one; they are sent on a few MB at a time."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    files = _loaded(lambda: reader.load(folder), folder).select("path", _folder(F.col("path")).alias("folder"), stem(F.col("path")).alias("book_id"), *([] if opened else ["content"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, (path, at, book) in enumerate(zip(batch["path"], batch["folder"], batch["book_id"])):
                if opened:
                    with open_file(path) as file:
                        yield from _batched(extract(file), at, book)
                else:
                    yield from _batched(extract(batch["content"].iat[i]), at, book)

    return files.mapInPandas(run, "folder string, book_id string, page_no int, text string")


def parted(file: BinaryIO, end: bytes, step: int = 1 << 20) -> Iterator[str]:
    """An extractor for opened files: the texts that a file holds, each ended by `end`, one byte. What is after the last end is a text too, unless it is empty."""
    rest: list[bytes] = []
    while block := file.read(step):
        first, *others = block.split(end)
        rest.append(first)
        for part in others:
            yield b"".join(rest).decode()
            rest = [part]
    if any(rest):
        yield b"".join(rest).decode()


def block_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int = 8) -> DataFrame:
    """Audio blocks as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


SEGMENTS = "segments array<struct<start: double, end: double, text: string, words: array<struct<start: double, word: string>>>>"


def transcripts(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, segment_no, start, end, text, words of JSON transcripts: what a recogniser, run elsewhere, has written."""
    reader = spark.read.schema(SEGMENTS).option("recursiveFileLookup", recursive)
    rows = _loaded(lambda: reader.json(folder, multiLine=True), folder).select(_plain(F.col("_metadata.file_path")).alias("path"), F.posexplode_outer("segments").alias("segment_no", "s"))
    return rows.where("s is not null").select("path", "segment_no", "s.start", "s.end", "s.text", "s.words")


def many_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """The same of very many files in UTF-8, in a folder and those below: they are listed and read by a fixed number of tasks."""
    one = SEGMENTS.split(" ", 1)
    read = F.from_json(F.col("content").cast("string"), f"array<struct<{one[0]}: {one[1]}>>")  # an object is an array of itself
    rows = read_named(spark, folder).select("path", F.explode(read).alias("r")).select("path", F.posexplode("r.segments").alias("segment_no", "s"))
    return rows.where("s is not null").select("path", "segment_no", "s.start", "s.end", "s.text", "s.words")


def write_clips(clips: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The clips of a stream as Parquet, each once. trigger: as of DataStreamWriter.trigger."""
    writer = clips.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def write_transcript(lines: DataFrame, path: str, key: str) -> None:
    """One text file for each key, in a folder key=..: a transcript is for one reader. Keys are dealt to all tasks. What is at the path is replaced."""
    texts = transcript_texts(lines, key).select(key, F.lit("part-00000.txt").alias("_name"), F.concat("text", F.lit("\n")).cast("binary").alias("_content"))
    write_named(texts, path, [key], "_name", "_content", replace=True)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("book_id").parquet(path)
