"""Chunks of chapters that are never put together: a chapter of any size is cleaned and chunked in pieces.

Pages are dealt to tasks by ranges of book and page, so a task has pages that follow each other, and their text travels once. A task cuts the chapters that it meets after a line
that ends a sentence and before one that begins with a letter, once for about each `PIECE_BYTES`. No step of the cleaning chain looks across such a place, and a sentence ends there,
so the pieces' cleaned sentences are those of the chapter. Only what is before the first such place or heading of a task, and after the last, may go on in another task: these
edges are put together afterwards.

How sentences group into chunks depends on how full the last chunk is when a piece begins. Pieces that follow each other are held in blocks of about `BLOCK_BYTES`. Each block says
how many chapters begin in it and, for every state of the last chunk, how many chunks its text before the first of them opens and in which state it ends (a table of `most` + 2
numbers). The blocks of a book are followed in order, a row of numbers for each, and each block then makes its chunks from the state it begins in. Only the chunks that pass
from a block to the next are put together afterwards.

Defined results: null pages are empty; a chapter without a place to cut is one piece; so is a sentence, however long, because a chunk holds whole sentences; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leafgate.functions.text import clean, is_stripped_heading, split_lines, strip_ends, text_or_empty
from leafgate.operators.chunks import BETWEEN, WORDS
from leafgate.operators.lines import MIN_PAGES
from leafgate.plans.scratch import fresh

PIECE_BYTES = 1 << 20
#: Bytes of text in a row of pieces, about.
BLOCK_BYTES = 1 << 20
_PIECE = "book_id string, part int, seq long, opens boolean, filled boolean, head boolean, tail boolean, text string, edge string"
_BLOCK = "book_id string, part int, seq long, head boolean, tail boolean, filled boolean, opens array<boolean>, texts array<string>, n_opens long, opened array<long>, after array<int>, state int, chunk long"
_ENDS = (".", "!", "?")
_ARROW_PIECE = pa.schema([("book_id", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("opens", pa.bool_()), ("filled", pa.bool_()), ("head", pa.bool_()), ("tail", pa.bool_()), ("text", pa.string()), ("edge", pa.string())])
_ARROW_BLOCK = pa.schema(
    [("book_id", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("filled", pa.bool_()), ("opens", pa.list_(pa.bool_())), ("texts", pa.list_(pa.string())), ("n_opens", pa.int64())]
    + [("opened", pa.list_(pa.int64())), ("after", pa.list_(pa.int32())), ("state", pa.int32()), ("chunk", pa.int64())]
)
_ARROW_CHUNK = pa.schema([("book_id", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("chapter_no", pa.int32()), ("chunk_no", pa.int32()), ("chunk", pa.string()), ("edge", pa.bool_())])


def _kind(stripped: Column) -> Column:
    """Of a line: h (a heading), b (blank) or n."""
    return F.when(is_stripped_heading(stripped), "h").when(stripped == "", "b").otherwise("n")


def _in_order(by: DataFrame, lines: Column) -> DataFrame:
    """book_id, part, lines, kinds (a letter for each line) of pages that are dealt by ranges of book and page, in their order. lines: array of line_no, line, kind."""
    by = by.select("book_id", "page_no", lines.alias("_lines")).sortWithinPartitions("book_id", "page_no")
    kinds = F.array_join(F.transform("_lines", lambda x: x["kind"]), "")
    return by.select("book_id", F.spark_partition_id().alias("part"), F.transform("_lines", lambda x: x["line"]).alias("lines"), kinds.alias("kinds"))


def _of_rows(rows: DataFrame) -> DataFrame:
    rows = rows.select("book_id", "page_no", F.struct("line_no", "line", _kind(F.col("stripped")).alias("kind")).alias("_line"))
    by = rows.repartitionByRange("book_id", "page_no").groupBy("book_id", "page_no").agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
    return _in_order(by, F.col("_lines"))


def _key(stripped: Column) -> Column:
    """What a line is known by while lines are counted: 128 bits; null if it is blank."""
    return F.when(stripped != "", F.unhex(F.md5(stripped)))


def _of_pages(pages: DataFrame, min_pages: int) -> DataFrame:
    """The same of pages, without their repeated lines. Lines travel as keys, to be counted; the keys of repeated ones go to their pages."""
    pages = pages.select("book_id", "page_no", text_or_empty("text").alias("text"))
    own = F.array_distinct(F.transform(split_lines(F.col("text")), lambda x: _key(strip_ends(x))))
    keys = pages.select("book_id", "page_no", F.explode(own).alias("key")).where("key is not null")
    repeated = _kept(keys.groupBy("book_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("book_id", "key"), "repeated")
    gone = keys.join(repeated, ["book_id", "key"], "left_semi").groupBy("book_id", "page_no").agg(F.collect_list("key").alias("keys"))
    both = pages.withColumn("keys", F.lit(None).cast("array<binary>")).unionByName(gone.withColumn("text", F.lit(None).cast("string")))
    by = both.repartitionByRange("book_id", "page_no").groupBy("book_id", "page_no").agg(F.collect_list("text").alias("texts"), F.flatten(F.collect_list("keys")).alias("keys"))
    lines = F.flatten(F.transform("texts", lambda t: F.transform(split_lines(t), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), strip_ends(x).alias("stripped")))))
    by = by.withColumn("_all", F.array_sort(lines))
    left = F.filter("_all", lambda x: (x["stripped"] == "") | ~F.array_contains("keys", _key(x["stripped"])))
    by = by.withColumn("_left", F.when(F.size("keys") > 0, left).otherwise(F.col("_all")))
    return _in_order(by, F.transform("_left", lambda x: F.struct(x["line_no"], x["line"], _kind(x["stripped"]).alias("kind"))))


def _cut(pages: Iterator[tuple[str | None, list[str], str]], piece_bytes: int) -> Iterator[tuple]:
    """book, opens (a chapter begins), filled (not blank), head, tail, text of the pieces of a task's pages. head: it may go on from an earlier task; tail: it may go on in a later one."""
    held: list[str] = []
    book, size, opens, filled, head, any_page = None, 0, False, False, True, False
    for own, lines, kinds in pages:
        if any_page and own != book:
            if held:
                yield book, opens, filled, head, False, "".join(held)
            held, size, opens, filled, head = [], 0, True, False, False
        book, any_page = own, True
        for line, kind in zip(lines, kinds):
            if kind == "h":
                if held:
                    yield book, opens, filled, head, False, "".join(held)
                held, size, opens, filled, head = [], 0, True, False, False
                continue
            if held and (head or size >= piece_bytes) and held[-1][-2:-1] in _ENDS and line[:1].isalpha():
                yield book, opens, filled, head, False, "".join(held)
                held, size, opens, filled, head = [], 0, False, False, False
            held.append(line + "\n")
            size += len(line.encode()) + 1
            filled = filled or kind == "n"
    if held or opens:
        yield book, opens, filled, head, True, "".join(held)


def _raw(ordered: DataFrame, piece_bytes: int) -> DataFrame:
    """Pieces, not cleaned, and edges, whose text is in a column of its own, in order: part and seq number them."""
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def pages() -> Iterator[tuple[str | None, list[str], str]]:
            nonlocal part
            for batch in batches:
                columns = [batch.column(c) for c in ("book_id", "part", "lines", "kinds")]
                for i in range(batch.num_rows):
                    book, part, lines, kinds = (c[i].as_py() for c in columns)
                    yield book, lines, kinds

        for seq, (book, opens, filled, head, tail, text) in enumerate(_cut(pages(), piece_bytes)):
            held = (book, part, seq, opens, filled, head, tail, *((None, text) if head or tail else (text, None)))
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, held)}, _ARROW_PIECE)

    return ordered.mapInArrow(run, _PIECE)


def _joined(edges: DataFrame) -> DataFrame:
    """book_id, part, seq, opens, filled, text of edges (with edge, their text) that are put together. The first one of a book opens a chapter."""
    by = Window.partitionBy("book_id").orderBy("part", "seq")
    first = ~F.col("head") | ~F.coalesce(F.lag("tail").over(by), F.lit(False))
    edges = edges.withColumn("_first", first).withColumn("_n", F.sum(F.col("_first").cast("int")).over(by))
    whole = edges.groupBy("book_id", "_n").agg(F.min(F.struct("part", "seq", "head", "opens")).alias("a"), F.max("filled").alias("filled"), F.expr("listagg(edge, '') within group (order by part, seq)").alias("text"))
    return whole.select("book_id", "a.part", "a.seq", (F.col("a.head") | F.col("a.opens")).alias("opens"), "filled", "text")


def pieces(rows: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """book_id, part, seq (which number them), opens (a chapter begins), filled, text (not cleaned). rows: of lines.strip_repeated. Written to the shared folder."""
    raw = _kept(_raw(_of_rows(rows), piece_bytes), "raw")
    whole = raw.where("not head and not tail").drop("head", "tail", "edge")
    return whole.unionByName(_joined(raw.where("head or tail")))


def _words(sentences: list[str]) -> list[int]:
    return [len(s.split()) for s in sentences]


def _table(sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each state (words in the last chunk; most + 1: it takes no more, or there is none): chunks opened, and the state after."""
    # all states whose last chunk takes no more at one sentence go on alike: from a sentence that opens a chunk to the next that does
    until, n = np.append(0, np.cumsum(sizes, dtype=np.int64)), len(sizes)
    after = np.maximum(np.searchsorted(until, until[:-1] + most, side="right") - 1, np.arange(n) + 1).tolist()
    opened, end = [0] * (n + 1), np.minimum(until[-1] - until, most + 1).tolist()
    for i in range(n - 1, -1, -1):
        opened[i] = opened[after[i]] + 1
        if after[i] < n:
            end[i] = end[after[i]]
    states = np.arange(most + 2)
    first = np.maximum(np.searchsorted(until, most - states, side="right") - 1, 0)
    return np.array(opened)[first], np.where(first < n, np.array(end)[first], np.minimum(states + until[-1], most + 1))


def _alone(sizes: list[int], state: int, most: int) -> tuple[int, int]:
    """The state after, and chunks opened, from one state: what the table says of it, a sentence at a time."""
    opened = 0
    for n in sizes:
        if state + n > most:
            state, opened = n, opened + 1
        else:
            state += n
        state = min(state, most + 1)
    return state, opened


def _blocks(rows: DataFrame, most: int, block_bytes: int) -> DataFrame:
    """Pieces that follow each other as rows of about block_bytes with their tables; an edge, which is not cleaned yet, is a row of its own. Pieces of blank text are left out: each is
    a chapter by itself."""

    def made(own: list[tuple]) -> dict:
        book, part, seq, _, filled, head, tail, *_ = own[0]
        out = {"book_id": book, "part": part, "seq": seq, "head": head, "tail": tail, "filled": filled, "opens": [r[3] for r in own], "texts": [r[8] if head or tail else r[7] for r in own]}
        n_opens, lead, state, chunk = 0, [], 0, 0
        for r in own if not head and not tail else []:
            sizes = _words(BETWEEN.split(r[7]))
            if r[3]:
                n_opens, state, chunk = n_opens + 1, most + 1, 0
            if n_opens:
                state, more = _alone(sizes, state, most)
                chunk += more
            else:
                lead += sizes
        opened, after = _table(lead, most) if lead else (None, None)
        return out | {"n_opens": n_opens, "opened": opened, "after": after, "state": state, "chunk": chunk}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("book_id", "part", "seq", "opens", "filled", "head", "tail", "text", "edge")]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in columns)
                if own and (size >= block_bytes or own[-1][:2] != row[:2] or row[5] or row[6] or own[-1][5] or own[-1][6]):
                    yield pa.RecordBatch.from_pylist([made(own)], _ARROW_BLOCK)
                    own, size = [], 0
                own.append(row)
                size += len(row[7] or "")
        if own:
            yield pa.RecordBatch.from_pylist([made(own)], _ARROW_BLOCK)

    return rows.where("filled or head or tail").select(*(c.split()[0] for c in _PIECE.split(", "))).mapInArrow(run, _BLOCK)


def _begun(blocks: DataFrame, most: int) -> DataFrame:
    """part, seq, chapter_no, state, chunk (how many were opened before): how each block begins. A task goes through the rows of a book in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, begun = None, False
        for batch in batches:
            out = []
            for book, n, opened, after, state, chunk in zip(*(batch[c] for c in ("book_id", "n_opens", "opened", "after", "state", "chunk"))):
                if not begun or of != book:
                    of, begun, now = book, True, (0, most + 1, 0)
                out.append(now)
                if opened is not None:
                    now = (now[0], int(after[now[1]]), now[2] + int(opened[now[1]]))
                if n:
                    now = (now[0] + int(n), int(state), int(chunk))
            yield batch[["part", "seq"]].assign(chapter_no=[x[0] for x in out], state=[x[1] for x in out], chunk=[x[2] for x in out])

    ordered = blocks.select("book_id", "part", "seq", "n_opens", "opened", "after", "state", "chunk").repartition("book_id").sortWithinPartitions("book_id", "part", "seq")
    return ordered.mapInPandas(run, "part int, seq long, chapter_no long, state int, chunk long")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that it is made once."""
    at = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _chunked(ordered: DataFrame, most: int, piece_bytes: int, block_bytes: int) -> DataFrame:
    raw = _raw(ordered, piece_bytes).withColumn("text", clean(F.col("text")))  # in no branch of a condition, where Spark would make each step several times
    blocks = _kept(_blocks(raw, most, block_bytes), "pieces")
    edges = _joined(blocks.where("head or tail").select("book_id", "part", "seq", "head", "tail", "filled", F.get("opens", F.lit(0)).alias("opens"), F.get("texts", F.lit(0)).alias("edge")))
    edges = edges.select("book_id", "part", "seq", "opens", "filled", F.lit(False).alias("head"), F.lit(False).alias("tail"), clean(F.col("text")).alias("text"), F.lit(None).cast("string").alias("edge"))
    blocks = blocks.where("not head and not tail").unionByName(_kept(_blocks(edges, most, 0), "edges"))
    starts = _kept(_begun(blocks, most), "starts").withColumnsRenamed({"state": "_state", "chunk": "_chunk"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("book_id", "part", "seq", "opens", "texts", "chapter_no", "_state", "_chunk")]
            for i in range(batch.num_rows):
                book, part, seq, opens, texts, chapter, state, chunk = (c[i].as_py() for c in columns)
                groups: list[list] = []  # chapter_no, chunk_no, sentences
                number = chunk - 1
                for new, text in zip(opens, texts):
                    if new:
                        chapter, state, number = chapter + 1, most + 1, -1
                    sentences = BETWEEN.split(text)
                    for s, n in zip(sentences, _words(sentences)):
                        if state + n > most:
                            number, state = number + 1, n
                            groups.append([chapter, number, s])
                        else:
                            state += n
                            if groups and groups[-1][:2] == [chapter, number]:
                                groups[-1].append(s)
                            else:  # goes on with the chunk of the block before
                                groups.append([chapter, number, s])
                        state = min(state, most + 1)
                edges = {0, len(groups) - 1} if not opens[0] else {len(groups) - 1}
                out = [{"book_id": book, "part": part, "seq": seq, "chapter_no": c, "chunk_no": k, "chunk": " ".join(s), "edge": j in edges} for j, (c, k, *s) in enumerate(groups)]
                yield pa.RecordBatch.from_pylist(out, _ARROW_CHUNK)

    kept = blocks.select("book_id", "part", "seq", "opens", "texts").join(starts, ["part", "seq"])
    parts = kept.mapInArrow(run, "book_id string, part int, seq long, chapter_no int, chunk_no int, chunk string, edge boolean")
    of = ["book_id", "chapter_no", "chunk_no"]
    whole = parts.where("edge").groupBy(*of).agg(F.expr("listagg(chunk, ' ') within group (order by part, seq)").alias("chunk"))
    return parts.where("not edge").select(*of, "chunk").unionByName(whole)


def chunked_by_words(rows: DataFrame, most: int = WORDS, piece_bytes: int = PIECE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """book_id, chapter_no, chunk_no (from 0), chunk of all chapters: what chunks.by_words gives of their cleaned texts. rows: of lines.strip_repeated; book_id is text.
    Cleaned pieces are written to the shared folder."""
    return _chunked(_of_rows(rows), most, piece_bytes, block_bytes)


def chunked_pages_by_words(pages: DataFrame, most: int = WORDS, piece_bytes: int = PIECE_BYTES, block_bytes: int = BLOCK_BYTES, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same of pages (book_id, page_no, text), whose repeated lines are left out: lines are not sent one by one. Lines are counted by 128 bits of their MD5."""
    return _chunked(_of_pages(pages, min_pages), most, piece_bytes, block_bytes)
