"""A query for each operator over the driver's tables, with DuckDB SQL of the same meaning.

documents stand for pages (book: source, page: doc_id), labels for finished results, events for audio blocks,
embeddings for samples, conversations for transcripts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafgate.functions import signal, text as tx
from leafgate.operators import acronyms, chapters as ch, chunks, gate, lines as ln, manifest as mf, pcm, pieces, transcript as tr
from leafgate.plans import book, engines
from leafgate.plans.scratch import fresh
from leafgate.plans.ship import shipped
from leafgate.sources import files
from leafgate.sources.live import sound_stream
from leafgate.sources.named import read_named, write_named
from leafgate.streaming.blocks import block_stream
from leafgate.streaming.gate import gate_stream
from leafgate.streaming.ordered import ordered_gate_stream

#: Bytes of a file of text that are held at a time.
PIECE_BYTES = 1 << 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), "text")


_DIRTY = r"""concat(' 12 ', chr(10), chr(10), replace(replace(text, ' th', concat('-', chr(10), 'th')), ' re', concat(chr(9), '  ', chr(7), 're')), chr(10), '   ', chr(10), chr(10), chr(10), 'THE NASA ACT ÉCOLE', chr(10), doc_id, chr(10))"""
_D = f"WITH d AS (SELECT doc_id, {_DIRTY} AS t FROM documents)"
_ACR = ", ".join(f"'{a}'" for a in tx.ACRONYMS)


def _o_deshout(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN regexp_full_match(w, '[A-Z]{{3,}}') AND w NOT IN ({_ACR}) THEN w[1] || lower(w[2:]) ELSE w END), '')"


_O_STEPS = [
    lambda t: f"regexp_replace({t}, '-\\n([\\p{{L}}\\p{{N}}_])', '\\1', 'g')",
    lambda t: f"regexp_replace({t}, '(?m)^\\s*\\d+\\s*$', '', 'g')",
    lambda t: f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')",
    lambda t: f"regexp_replace({t}, '[ \\t]+', ' ', 'g')",
    lambda t: f"regexp_replace({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')",
    _o_deshout,
    lambda t: f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')",
]
_O_CHAIN = "t"
for _step in _O_STEPS:
    _O_CHAIN = _step(_O_CHAIN)


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_DIRTY.replace("chr(", "char(")).alias("t"))


def _cleaning(name: str, step, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dirty(spark, sf_dir).select("doc_id", step(F.col("t")).alias("out"))

    run.__name__ = name
    query(f"{_D} SELECT doc_id, {oracle} AS out FROM d")(run)


for _name, _f, _o in zip(("join_hyphens", "drop_numeric_lines", "squeeze_blank_lines", "squeeze_spaces", "strip_controls", "deshout", "strip_ends"), (tx.join_hyphens, tx.drop_numeric_lines, tx.squeeze_blank_lines, tx.squeeze_spaces, tx.strip_controls, tx.deshout, tx.strip_ends), _O_STEPS):
    _cleaning(_name, _f, _o("t"))
_cleaning("clean_chain", tx.clean, _O_CHAIN)

# lines and chapters: the first line of every seventh document is made a heading
_HEADED = "CASE WHEN doc_id % 7 = 0 THEN concat('Chapter ', doc_id, substr(text, CAST(CASE WHEN position(chr(10) IN text) = 0 THEN length(text) + 1 ELSE position(chr(10) IN text) END AS INT))) ELSE text END"
_O_LINES = """l AS (SELECT book_id, page_no, i - 1 AS line_no, ls[i] AS line, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS stripped
  FROM (SELECT book_id, page_no, ls, unnest(range(1, len(ls) + 1 - CASE WHEN ls[len(ls)] = '' THEN 1 ELSE 0 END)) AS i FROM (SELECT book_id, page_no, string_split(t, chr(10)) AS ls FROM p))),
rep AS (SELECT book_id, stripped, count(*) AS n_pages FROM (SELECT DISTINCT book_id, page_no, stripped FROM l WHERE stripped <> '') GROUP BY ALL HAVING count(*) >= 5)"""
_O_PAGES = "WITH p AS (SELECT source AS book_id, doc_id AS page_no, coalesce(text, '') AS t FROM documents), " + _O_LINES
_O_HEADED = f"WITH p AS (SELECT source AS book_id, doc_id AS page_no, coalesce({_HEADED}, '') AS t FROM documents), " + _O_LINES
_O_IS_HEADING = "(length(stripped) <= 80 AND regexp_matches(stripped, '(?i)^(?:" + "|".join(tx.HEADINGS).replace("\\w", "[\\p{L}\\p{N}_]") + ")'))"


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_no"), F.expr(_HEADED.replace("chr(", "char(")).alias("text"))
    return pages


def _stripped(pages: DataFrame) -> DataFrame:
    return ln.strip_repeated(ln.lines(pages), repeated=ln.repeated_of_pages(pages))


@query(f"{_O_PAGES} SELECT * FROM rep")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.repeated_of_pages(_pages(spark, sf_dir))


@query(f"{_O_PAGES} SELECT book_id, page_no, CAST(line_no AS INT) AS line_no, line, stripped FROM l ANTI JOIN rep USING (book_id, stripped)")
def strip_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stripped(_pages(spark, sf_dir))


@query(f"{_O_HEADED} SELECT book_id, page_no, CAST(line_no AS INT) AS line_no, stripped FROM l WHERE {_O_IS_HEADING}")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.headings(ln.lines(_headed(spark, sf_dir))).select("book_id", "page_no", "line_no", "stripped")


_O_CHAPTERS = f"""{_O_HEADED},
h AS (SELECT *, {_O_IS_HEADING} AS heading FROM l ANTI JOIN rep USING (book_id, stripped)),
s AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY book_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) AS seg FROM h),
g AS (SELECT book_id, seg, coalesce(max(stripped) FILTER (heading), 'Front Matter') AS title, string_agg(line || chr(10), '' ORDER BY page_no, line_no) FILTER (NOT heading) AS text,
      count(*) FILTER (NOT heading AND stripped <> '') AS filled FROM s GROUP BY book_id, seg),
c AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY seg) AS INT) AS chapter_no, title, text FROM g WHERE filled > 0)"""


@query(f"{_O_CHAPTERS} SELECT * FROM c")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chapters(_stripped(_headed(spark, sf_dir)))


@query(f"{_O_CHAPTERS} SELECT book_id, count(*) AS n_chapters, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM c GROUP BY book_id")
def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n_chapters"), F.sum(tx.word_count(F.col("text"))).alias("n_words"))


_O_SENT = "regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g')"


@query(f"SELECT doc_id, CAST(i - 1 AS INT) AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split({_O_SENT}, chr(1)) AS s FROM documents))")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.split_sentences(tx.text_or_empty("text"))).alias("sentence_no", "sentence"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS INT) AS n_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.word_count(tx.text_or_empty("text")).alias("n_words"))


_WORDS_OF = "len(list_filter(regexp_split_to_array(s[i + 1], '\\s+'), lambda y: y <> ''))"
_TRIM = "regexp_replace(cur, '^\\s+|\\s+$', '', 'g')"
_O_CHARS = f"""WITH RECURSIVE d AS (SELECT doc_id, string_split({_O_SENT}, chr(1)) AS s FROM documents),
f AS (SELECT doc_id, s, 0 AS i, CAST([] AS VARCHAR[]) AS done, '' AS cur FROM d
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN full_ THEN list_append(done, {_TRIM}) ELSE done END, (CASE WHEN full_ THEN '' ELSE cur END) || s[i + 1] || ' '
  FROM (SELECT *, length(cur) + length(s[i + 1]) > 4000 AND cur <> '' AS full_ FROM f WHERE i < len(s))),
e AS (SELECT doc_id, CASE WHEN {_TRIM} <> '' THEN list_append(done, {_TRIM}) ELSE done END AS c FROM f WHERE i = len(s))"""
_O_WORDS = f"""WITH RECURSIVE d AS (SELECT doc_id, string_split({_O_SENT}, chr(1)) AS s FROM documents),
f AS (SELECT doc_id, s, 0 AS i, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS cur, CAST(0 AS BIGINT) AS n FROM d
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN full_ THEN list_append(done, array_to_string(cur, ' ')) ELSE done END, CASE WHEN full_ THEN [s[i + 1]] ELSE list_append(cur, s[i + 1]) END, CASE WHEN full_ THEN m ELSE n + m END
  FROM (SELECT *, n + m > 200 AND len(cur) > 0 AS full_ FROM (SELECT *, {_WORDS_OF} AS m FROM f WHERE i < len(s)))),
e AS (SELECT doc_id, list_append(done, array_to_string(cur, ' ')) AS c FROM f WHERE i = len(s))"""
_O_CHUNKS = " SELECT doc_id, CAST(j - 1 AS INT) AS chunk_no, c[j] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS j FROM e)"


@query(_O_CHARS + _O_CHUNKS)
def chunks_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", tx.text_or_empty("text").alias("text"))
    return chunks.chunked(docs, chunks.by_chars(F.col("text")))


@query(_O_WORDS + _O_CHUNKS)
def chunks_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", tx.text_or_empty("text").alias("text"))
    return chunks.chunked(docs, chunks.by_words(F.col("text")))


@query(_O_WORDS + " SELECT doc_id, j - 1 AS chunk_no, printf('%04d.wav', j - 1) AS part FROM (SELECT doc_id, CAST(unnest(range(1, len(c) + 1)) AS INT) AS j FROM e)")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.part_names(chunks_words(spark, sf_dir)).select("doc_id", "chunk_no", "part")


_O_NAME = "printf('%02d_', CAST({n} AS INT)) || regexp_replace(substr(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), 1, 50), '^\\s+|\\s+$', '', 'g') || '.mp3'"
_O_FIRST = "string_split(coalesce(text, ''), chr(10))[1]"


@query(f"SELECT doc_id, {_O_NAME.format(n='doc_id', t=_O_FIRST)} AS fname FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.safe_name(F.col("doc_id").cast("int"), F.element_at(F.split(tx.text_or_empty("text"), "\n"), 1)).alias("fname"))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", chunks.n_by_words(tx.text_or_empty("text")).alias("n_chunks"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id").distinct()


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.pending(_table(spark, sf_dir, "documents").select("doc_id", "source"), _done(spark, sf_dir), "doc_id")


@query("SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.finished(_table(spark, sf_dir, "documents").select("doc_id", "source"), _done(spark, sf_dir), "doc_id")


@query(_O_WORDS + """, w AS (SELECT source, len(c) AS n, doc_id IN (SELECT doc_id FROM labels) AS done FROM e JOIN documents USING (doc_id))
SELECT source, count(*) AS n_items, count(*) FILTER (done) AS n_done, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(coalesce(sum(n) FILTER (done), 0) AS BIGINT) AS chunks_done FROM w GROUP BY source""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.progress(_work(spark, sf_dir), _done(spark, sf_dir), "doc_id", "source")


@query("SELECT source, count(*) AS n_files, string_agg(printf('%02d_x.mp3', doc_id), '|' ORDER BY printf('%02d_x.mp3', doc_id)) AS files, source || '_full.mp3' AS output FROM documents GROUP BY source")
def stitch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select("source", F.format_string("%02d_x.mp3", "doc_id").alias("fname"))
    return mf.stitched(files, "source")


@query("SELECT source, count(*) AS n_files, string_agg(printf('%02d_x.mp3', doc_id), '|' ORDER BY doc_id) AS files, source || '_full.mp3' AS output FROM documents GROUP BY source")
def stitch_order_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select("source", F.format_string("%02d_x.mp3", "doc_id").alias("fname"))
    return mf.stitched(files, "source", numeric=True)


_O_MIXED = "CASE WHEN doc_id % 3 = 0 THEN 'Part_' WHEN doc_id % 3 = 1 THEN 'part_' ELSE 'PARTLY_' END || doc_id || '.mp3'"


@query(f"SELECT source, count(*) AS n_files, string_agg({_O_MIXED}, '|' ORDER BY lower({_O_MIXED}), {_O_MIXED}) AS files, source || '_full.mp3' AS output FROM documents GROUP BY source")
def stitch_order_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in an order that does not look at case."""
    names = _table(spark, sf_dir, "documents").select("source", F.expr(_O_MIXED).alias("fname"))
    return mf.stitched(names, "source", fold=True)


@query(f"{_D} SELECT doc_id, {_O_STEPS[5]('t')} AS out FROM d")
def deshout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that stay are a table."""
    words = spark.createDataFrame([(a,) for a in tx.ACRONYMS], "word string")
    return acronyms.deshouted(_dirty(spark, sf_dir), "doc_id", words, "t").select("doc_id", F.col("t").alias("out"))


@query("SELECT doc_id, n_chars // 1024 AS kb, round(n_chars / 1048576, 1) AS mb, regexp_replace(printf('%d', n_chars), '(\\d)(\\d{3})$', '\\1,\\2') AS said FROM documents")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.kilobytes(F.col("n_chars")).alias("kb"), tx.megabytes(F.col("n_chars")).alias("mb"), tx.thousands(F.col("n_chars")).alias("said"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem, regexp_replace(url, '([^/])\\.[^./]*$', '\\1') || '.transcript.txt' AS transcript FROM pages")
def path_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", tx.stem(F.col("url")).alias("stem"), tx.with_suffix(F.col("url"), ".transcript.txt").alias("transcript"))


@query("SELECT event_id, 'clip_' || strftime(ts, '%Y%m%d_%H%M%S') AS clip FROM events")
def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", tx.clip_name(F.col("ts")).alias("clip"))


@query("SELECT doc_id, round(strlen(coalesce(text, '')) / (44100 * 2 * 2), 6) AS seconds FROM documents")
def pcm_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(signal.pcm_seconds(F.octet_length(tx.text_or_empty("text")), 44100, 2), 6).alias("seconds"))


@query("SELECT vec_id, round(CASE WHEN len(embedding) = 0 THEN 0 ELSE sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)) END, 6) AS level FROM embeddings")
def vector_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.rms(F.col("embedding")), 6).alias("level"))


@query("SELECT vec_id, CAST(i - 13 AS INT) AS pos, embedding[i] AS sample FROM (SELECT vec_id, embedding, unnest(range(13, 33)) AS i FROM embeddings)")
def trim_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.trimmed(F.col("embedding"), 4, 3.0, 5.0)).alias("pos", "sample"))


_O_GATE = """WITH a AS (SELECT user_id, ts, event_id, value >= 60 AS audible, epoch_us(ts) / 1e6 AS t FROM events),
r AS (SELECT *, sum(CAST(audible AS INT)) OVER w AS run FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, min(t) FILTER (NOT audible) OVER (PARTITION BY user_id, run) AS s0 FROM r WHERE run > 0),
p AS (SELECT *, NOT audible AND t - s0 >= 86400 AS past FROM s),
q AS (SELECT *, sum(CAST(past AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth, coalesce(lag(past) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AND audible AS opens FROM p),
c AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clip_no FROM q),
g AS (SELECT user_id, CAST(clip_no AS BIGINT) AS clip_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts, count(*) AS n_blocks, round(max(t) - min(t), 3) AS seconds, bool_or(past) AS closed FROM c WHERE NOT past OR nth = 1 GROUP BY ALL)"""


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate.gate_clips(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", F.col("value"), 60, 86400)
    said = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_ts", "end_ts")}
    return out.withColumns({"seconds": F.round("seconds", 3), **said})


@query(f"{_O_GATE} SELECT * FROM g")
def gate_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query(_O_GATE.replace("SELECT user_id, ts,", "SELECT 0 AS user_id, ts,").replace("86400", "600") + " SELECT CAST(user_id AS INT) AS device, clip_no, start_ts, end_ts, n_blocks, seconds, closed FROM g")
def gate_one_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the blocks of one device: its spans of time go to tasks of their own."""
    events = _table(spark, sf_dir, "events").withColumn("device", F.lit(0))
    out = gate.gate_clips(events, "device", ["ts", "event_id"], "ts", F.col("value"), 60, 600)
    said = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_ts", "end_ts")}
    return out.withColumns({"seconds": F.round("seconds", 3), **said})


@query(f"{_O_GATE} SELECT * FROM g WHERE seconds >= 172800")
def gate_min_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.long_enough(_gate(spark, sf_dir), 172800)


@query(_O_GATE.rsplit("g AS (", 1)[0].rstrip().rstrip(",") + """, b AS (SELECT c.user_id, CAST(clip_no AS BIGINT) AS clip_no, coalesce(props, '') AS p, c.ts, c.event_id FROM c JOIN events USING (event_id) WHERE NOT past OR nth = 1)
SELECT user_id, clip_no, CAST(sum(strlen(p)) AS BIGINT) AS n_bytes, md5(string_agg(p, '' ORDER BY ts, event_id)) AS digest FROM b GROUP BY ALL""")
def clip_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("pcm", F.coalesce("props", F.lit("")).cast("binary"))
    rows = gate.gate_blocks(events, "user_id", ["ts", "event_id"], "ts", F.col("value"), 60, 86400, keep=["pcm"])
    return gate.clip_payloads(rows, "user_id", ["ts", "event_id"], "pcm").select("user_id", "clip_no", "n_bytes", F.md5("payload").alias("digest"))


@query("SELECT vec_id, i // 16 AS block_no, count(*) AS n, round(sqrt(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS level FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return gate.sample_blocks(samples, "vec_id", "i", "x", 16).withColumn("level", F.round("level", 6))


def _segments(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """dealt: each conversation's in one task, of all tasks, before anything is made of them."""
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    said = said.repartition(4 * spark.sparkContext.defaultParallelism, "conv_id") if dealt else said
    words = F.filter(F.split(tx.text_or_empty("text"), r"\s+"), lambda w: w != "")
    timed = F.transform(words, lambda w, i: F.struct((i * 0.25).cast("double").alias("start"), w.alias("word")))
    return said.select(
        "conv_id", F.col("turn").alias("segment_no"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).cast("double").alias("end"), tx.text_or_empty("text").alias("text"), timed.alias("words")
    )


_O_TRANSCRIPT = """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws FROM conversations),
o AS (SELECT conv_id, turn AS segment_no, 0 AS word_no, chr(10) || '[' || printf('%.1f', CAST(turn AS DOUBLE)) || 's — ' || printf('%.1f', turn + CAST(0.5 AS DOUBLE)) || 's]  ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM c
  UNION ALL
  SELECT conv_id, turn, CAST(i AS INT), '    ' || lpad(printf('%.2f', CAST((i - 1) * 0.25 AS DOUBLE)) || 's', CAST(greatest(8, length(printf('%.2f', CAST((i - 1) * 0.25 AS DOUBLE))) + 1) AS INT), ' ') || '  ' || ws[i] FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c))"""


@query(f"{_O_TRANSCRIPT} SELECT * FROM o")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transcript_lines(_segments(spark, sf_dir), "conv_id")


@query(f"{_O_TRANSCRIPT} SELECT * FROM o ORDER BY conv_id, segment_no, word_no LIMIT 35")
def transcript_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.preview(transcript_lines(spark, sf_dir), "conv_id")


_O_COUNTS = "list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {'n': len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')), 'k': 1})"
_O_GREEDY = "list_reduce(m, lambda a, x: CASE WHEN a.n + x.n > 200 THEN {'n': x.n, 'k': a.k + 1} ELSE {'n': a.n + x.n, 'k': a.k} END).k"
_O_MANIFEST = f"""{_O_CHAPTERS},
k AS (SELECT book_id, chapter_no, title, {_O_CHAIN} AS t FROM (SELECT book_id, chapter_no, title, text AS t FROM c)),
n AS (SELECT book_id, chapter_no, title, {_O_COUNTS} AS m FROM k)
SELECT book_id, chapter_no, title, CAST({_O_GREEDY} AS BIGINT) AS n_chunks, {_O_NAME.format(n='chapter_no', t='title')} AS fname FROM n"""


@query(_O_MANIFEST)
def book_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: repeated lines, chapters, cleaning, word chunks, names."""
    return book.work(_headed(spark, sf_dir))


_O_BOOK_CHUNKS = f"""{_O_CHAPTERS},
k AS (SELECT book_id, chapter_no, {_O_CHAIN} AS t FROM (SELECT book_id, chapter_no, text AS t FROM c)),
{_O_WORDS.replace("WITH RECURSIVE d AS (SELECT doc_id, string_split(" + _O_SENT + ", chr(1)) AS s FROM documents)", "d AS (SELECT {'b': book_id, 'n': chapter_no} AS doc_id, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM k)")}
SELECT doc_id.b AS book_id, CAST(doc_id.n AS INT) AS chapter_no, CAST(j - 1 AS INT) AS chunk_no, md5(c[j]) AS digest FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS j FROM e)""".replace("WITH p", "WITH RECURSIVE p", 1)


@query(_O_BOOK_CHUNKS)
def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all chapters, which are cleaned and chunked in pieces and never put together."""
    return pieces.chunked_pages_by_words(_headed(spark, sf_dir), piece_bytes=1 << 14).select("book_id", "chapter_no", "chunk_no", F.md5("chunk").alias("digest"))


# sources and sinks: written to the shared folder, and read again


@query(_O_MANIFEST)
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "manifest")
    files.write_manifest(book_manifest(spark, sf_dir), at)
    return spark.read.schema("chapter_no int, title string, n_chunks long, fname string, book_id string").parquet(at)


def _decoded(folder: Column) -> Column:
    """A folder column=value as the value was, before it was made a name."""
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def _books(spark: SparkSession, sf_dir: str) -> str:
    """A text file for each source, in a folder of its own: its texts in order, each ended by a form feed. A task writes them one by one."""
    at = fresh(spark, "books")
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", tx.text_or_empty("text").alias("text"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").option("lineSep", "\f").text(at)
    return at


def _fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each source by what their documents have in common, each ended by a line feed."""
    return _table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5).alias("fifth"), "doc_id", tx.text_or_empty("text").alias("text"))


def _chapter_texts(spark: SparkSession, sf_dir: str) -> str:
    """Several text files for each source, in a folder of its own, named by what their documents have in common. A task writes a file's texts one by one."""
    at = fresh(spark, "chapters")
    texts = _fifths(spark, sf_dir).repartition("source", "fifth").sortWithinPartitions("source", "fifth", "doc_id")
    texts.select("source", "fifth", "text").write.partitionBy("source", "fifth").text(at)
    return at


def _chapter_folders(spark: SparkSession, sf_dir: str) -> str:
    """The same texts as several named files in the folder of each book."""
    at = fresh(spark, "folders")
    texts = _fifths(spark, sf_dir).select(F.col("source").alias("book"), F.format_string("part-%s.txt", "fifth").alias("name"), "doc_id", F.concat("text", F.lit("\n")).cast("binary").alias("content"))
    write_named(texts, at, ["book"], "name", "content", order=["doc_id"])
    return at


_O_FIFTHS = "SELECT source, doc_id % 5 AS fifth, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY ALL"


@query(f"SELECT 'fifth=' || fifth AS folder, 1 AS chapter_no, md5(t) AS digest, source FROM ({_O_FIFTHS})")
def chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file in each of the folders source=../fifth=.. ."""
    found = files.digests(files.chapter_files(spark, _chapter_texts(spark, sf_dir), recursive=True, piece_bytes=PIECE_BYTES))
    return found.select(F.col("book_id").alias("folder"), "chapter_no", "digest", _decoded(F.regexp_extract("path", "source=([^/]*)/", 1)).alias("source"))


@query(f"""SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY fifth) AS INT) AS chapter_no, 'part-' || fifth AS title, md5(t) AS digest FROM ({_O_FIFTHS})""")
def chapter_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several named files in the folder of each book, numbered by name."""
    found = files.digests(files.chapter_files(spark, _chapter_folders(spark, sf_dir), recursive=True, piece_bytes=PIECE_BYTES))
    return found.select(_decoded(F.regexp_replace("book_id", "^book=", "")).alias("book_id"), "chapter_no", "title", "digest")


@query("SELECT 'source=' || source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_no, md5(coalesce(text, '')) AS digest FROM documents")
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.extracted_pages(spark, _books(spark, sf_dir), lambda f: files.parted(f, b"\f"), "*.txt", recursive=True, opened=True)
    return pages.select(_decoded(F.col("folder")).alias("book_id"), "page_no", F.md5("text").alias("digest"))


@query(f"SELECT 'book=' || source AS book_id, 'part-' || fifth || '.txt' AS fname, CAST(strlen(t) AS BIGINT) AS length FROM ({_O_FIFTHS})")
def finished_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lengths of the files that are there."""
    at = _chapter_folders(spark, sf_dir)
    sizes = files.audio_files(spark, at, "*.txt", recursive=True)
    sizes = sizes.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("book_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("fname"), "length")
    return files.finished_outputs(spark, at, "*.txt").join(sizes, ["book_id", "fname"])


@query(_O_TRANSCRIPT + " SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY segment_no, word_no) || chr(10)) AS digest FROM o GROUP BY conv_id")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "transcripts")
    files.write_transcript(tr.transcript_lines(_segments(spark, sf_dir, dealt=True), "conv_id"), at, "conv_id")
    return read_named(spark, at).select(F.regexp_extract("path", r"conv_id=(-?\d+)/", 1).try_cast("long").alias("conv_id"), F.md5("content").alias("digest"))


@query("SELECT conv_id, CAST(turn AS INT) AS segment_no, coalesce(text, '') AS text, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS INT) AS n_words FROM conversations")
def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested segments as a recogniser writes them, a JSON file for each conversation."""
    at = fresh(spark, "recognised")
    one = F.struct("segment_no", "start", "end", "text", "words")
    said = _segments(spark, sf_dir, dealt=True).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    write_named(said.select("conv_id", F.lit("part-00000.json").alias("fname"), F.to_json(F.struct("segments")).cast("binary").alias("content")), at, ["conv_id"], "fname", "content")
    rows = files.many_transcripts(spark, at)
    return rows.select(F.regexp_extract("path", r"conv_id=(-?\d+)/", 1).try_cast("long").alias("conv_id"), "segment_no", "text", F.size("words").alias("n_words"))


@query(f"{_O_GATE} SELECT CAST(user_id AS VARCHAR) AS device, clip_no, start_ts, end_ts, n_blocks, seconds, closed FROM g WHERE seconds >= 172800")
def stream_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of blocks of text-named devices, an end for each device, clips of two days or more to a table."""
    at = fresh(spark, "blocks")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    ends = events.groupBy("device").agg(F.expr("max(ts) + interval 1 second").alias("ts"), F.max("event_id").alias("event_id"), F.lit(None).cast("double").alias("value"))
    events.unionByName(ends).write.parquet(at)
    stream = files.block_stream(spark, at, events.schema, files_per_trigger=1_000_000)
    clips = gate_stream(stream, "device", "ts", "event_id", "value", 60, 86400, least=172800, late="1 day")
    query = files.write_clips(clips, f"{at}-clips", f"{at}-state", availableNow=True)
    query.awaitTermination()
    out = spark.read.schema("key string, clip_no long, start_ts timestamp, end_ts timestamp, n_blocks long, seconds double, closed boolean").parquet(f"{at}-clips")
    said = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_ts", "end_ts")}
    return out.withColumnRenamed("key", "device").withColumns({"seconds": F.round("seconds", 3), **said})


@query(f"{_O_GATE} SELECT CAST(user_id AS VARCHAR) AS device, clip_no, start_ts, end_ts, n_blocks, seconds, closed FROM g WHERE seconds >= 172800")
def stream_clips_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of order: each third of the time comes in one run of the stream or the next, shuffled; then come blocks that are too late, which change nothing."""
    at = fresh(spark, "blocks")
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    ends = events.groupBy("device").agg(F.expr("max(ts) + interval 1 second").alias("ts"), F.max("event_id").alias("event_id"), F.lit(None).cast("double").alias("value"))
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        lo = hi = datetime(2000, 1, 1)
    third = (hi - lo) / 3
    dealt = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(lo))) / max(1, third / timedelta(microseconds=1))) + F.pmod(F.hash("event_id"), F.lit(2))
    parts = events.unionByName(ends).withColumn("part", F.least(dealt, F.lit(2)))
    last = spark.createDataFrame([("", hi + 9 * third + timedelta(days=9), 0, None)], events.schema)  # moves the watermark past all
    runs = [*(parts.where(F.col("part") == i).drop("part").orderBy(F.hash("event_id", "ts")) for i in range(3)), last, events.withColumn("value", F.lit(1e9))]
    for rows in runs:
        rows.write.mode("append").parquet(at)
        clips = ordered_gate_stream(files.block_stream(spark, at, events.schema, 1_000_000), "device", "ts", "event_id", "value", 60, 86400, least=172800, late=f"{int(third.total_seconds() * 1.1) + 9} seconds")
        files.write_clips(clips, f"{at}-clips", f"{at}-state", availableNow=True).awaitTermination()
    out = spark.read.schema("key string, clip_no long, start_ts timestamp, end_ts timestamp, n_blocks long, seconds double, closed boolean").parquet(f"{at}-clips")
    said = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_ts", "end_ts")}
    return out.withColumnRenamed("key", "device").withColumns({"seconds": F.round("seconds", 3), **said})


@query(_O_GATE.rsplit("g AS (", 1)[0].rstrip().rstrip(",") + """, b AS (SELECT c.user_id, CAST(clip_no AS BIGINT) AS clip_no, coalesce(props, '') AS p, c.ts, c.event_id FROM c JOIN events USING (event_id) WHERE NOT past OR nth = 1)
SELECT user_id, clip_no, CAST(sum(strlen(p)) AS BIGINT) AS n_bytes, 8000 AS rate, CAST(1 + arg_min(event_id, (ts, event_id)) % 2 AS INT) AS channels, round(sum(strlen(p)) / (8000 * 2 * (1 + arg_min(event_id, (ts, event_id)) % 2)), 6) AS seconds FROM b GROUP BY ALL""")
def clip_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumns({"pcm": F.coalesce("props", F.lit("")).cast("binary"), "rate": F.lit(8000), "channels": (1 + F.col("event_id") % 2).cast("int")})
    rows = gate.gate_blocks(events, "user_id", ["ts", "event_id"], "ts", F.col("value"), 60, 86400, keep=["pcm", "rate", "channels"])
    return gate.clip_audio(rows, "user_id", ["ts", "event_id"], "pcm", "rate", "channels").drop("payload").withColumn("seconds", F.round("seconds", 6))


_O_LE4 = "printf('%02X%02X%02X%02X', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216)"
_O_WAV = f"""from_hex('52494646' || {_O_LE4.format("36 + n + n % 2")} || '57415645666D7420100000000100' || printf('%02X00', ch) || {_O_LE4.format("CAST(8000 AS BIGINT)")} || {_O_LE4.format("16000 * ch")} || printf('%02X00', 2 * ch) || '100064617461' || {_O_LE4.format("n")}) || encode(p) || CASE WHEN n % 2 = 1 THEN from_hex('00') ELSE from_hex('') END"""


@query(_O_GATE.rsplit("g AS (", 1)[0].rstrip().rstrip(",") + f""", b AS (SELECT c.user_id, CAST(clip_no AS BIGINT) AS clip_no, coalesce(props, '') AS p, c.ts, c.event_id FROM c JOIN events USING (event_id) WHERE NOT past OR nth = 1),
w AS (SELECT user_id, clip_no, string_agg(p, '' ORDER BY ts, event_id) AS p, CAST(sum(strlen(p)) AS BIGINT) AS n, 1 + arg_min(event_id, (ts, event_id)) % 2 AS ch FROM b GROUP BY ALL)
SELECT 'user_id=' || user_id AS folder, printf('%06d.wav', clip_no) AS fname, CAST(44 + n + n % 2 AS BIGINT) AS length, md5({_O_WAV}) AS digest FROM w""")
def wav_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WAV file for each clip, written and read again."""
    events = _table(spark, sf_dir, "events").withColumns({"pcm": F.coalesce("props", F.lit("")).cast("binary"), "rate": F.lit(8000), "channels": (1 + F.col("event_id") % 2).cast("int")})
    rows = gate.gate_blocks(events, "user_id", ["ts", "event_id"], "ts", F.col("value"), 60, 86400, keep=["pcm", "rate", "channels"])
    clips = gate.clip_audio(rows, "user_id", ["ts", "event_id"], "pcm", "rate", "channels")
    at = fresh(spark, "clips")
    write_named(clips.select("user_id", F.format_string("%06d.wav", "clip_no").alias("fname"), signal.wav(F.col("payload"), F.col("rate"), F.col("channels")).alias("content")), at, ["user_id"], "fname", "content")
    return read_named(spark, at).select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("fname"), "length", F.md5("content").alias("digest"))


@query("""SELECT doc_id, round(CASE WHEN strlen(t) < 2 THEN 0 ELSE sqrt(list_sum(list_transform(regexp_extract_all(t, '..'), lambda p: pow(ascii(p[1]) + 256 * ascii(p[2]), 2))) / (strlen(t) // 2)) END, 3) AS level
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS t FROM documents)""")
def pcm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printable ASCII letters of each whole text as 16-bit samples."""
    block = F.regexp_replace(tx.text_or_empty("text"), "[^ -~]", "").cast("binary")
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(signal.pcm_rms(block), 3).alias("level"))


@query(_O_WORDS + ", j AS (SELECT doc_id, c, CAST(unnest(range(1, len(c) + 1)) AS INT) AS j FROM e) SELECT source AS book_id, CAST(doc_id AS INT) AS chapter_no, j - 1 AS chunk_no, md5('voice:' || c[j]) AS digest FROM j JOIN documents USING (doc_id)")
def synthesised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through a registered engine, which stands for a model: it gives back the voice and the text."""
    engines.register("echo", engines.Settings(lambda voice: lambda chunk: f"{voice}:{chunk}".encode(), "words", 200, needs_voice=True))
    settings = book.Settings(engine="echo", voice="voice").checked()
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("chapter_no"), tx.text_or_empty("text").alias("text"))
    audio = engines.synthesised(chunks.chunked(docs, settings.chunks(F.col("text"))), "echo", "voice")
    return audio.select("book_id", "chapter_no", "chunk_no", F.md5("audio").alias("digest"))


_O_SINC = "CASE WHEN abs({t}) >= {reach} THEN 0 ELSE {cut} * CASE WHEN {t} = 0 THEN 1 ELSE sin(pi() * {cut} * ({t})) / (pi() * {cut} * ({t})) END * (0.5 + 0.5 * cos(pi() * ({t}) / {reach})) END"


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as recordings, in blocks of ten samples."""
    of = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("embedding") - 1) / 10), F.lit(0))), lambda i: F.struct((i * 10).alias("at"), F.slice("embedding", (i * 10 + 1).cast("int"), 10).alias("x"))))
    return _table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", of.alias("b")).select("vec_id", F.col("b.at").alias("start"), F.col("b.x").alias("samples"))


@query(f"""WITH s AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k, len(embedding) AS n FROM embeddings),
m AS (SELECT vec_id, unnest(range(0, CAST(ceil(len(embedding) * 3 / 2) AS BIGINT))) AS m FROM embeddings)
SELECT vec_id, m AS frame, round(sum(CAST(x AS DOUBLE) * {_O_SINC.format(t="m * CAST(2 AS DOUBLE) / 3 - k", cut="1.0", reach="16.0")}), 6) + 0 AS sample FROM m JOIN s USING (vec_id) GROUP BY ALL""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples for every two, in blocks of eight that see their neighbours."""
    rows = pcm.resampled(_sound(spark, sf_dir), "vec_id", "start", "samples", 32000, 48000, frames=8)
    rows = rows.select("vec_id", "start", F.posexplode("samples").alias("i", "x"))
    return rows.select("vec_id", (F.col("start") + F.col("i")).alias("frame"), (F.round("x", 6) + 0).alias("sample"))


@query(f"""WITH s AS (SELECT vec_id, k, (CAST(embedding[2 * k + 9] AS DOUBLE) + embedding[2 * k + 10]) / 2 AS x FROM (SELECT vec_id, embedding, unnest(range(0, greatest(0, least(20, len(embedding) // 2 - 4)))) AS k FROM embeddings)),
m AS (SELECT vec_id, unnest(range(0, greatest(0, least(20, len(embedding) // 2 - 4) + 1) // 2)) AS m FROM embeddings)
SELECT vec_id, m AS frame, round(sum(x * {_O_SINC.format(t="m * CAST(2 AS DOUBLE) - k", cut="0.5", reach="32.0")}), 6) + 0 AS sample FROM m JOIN s USING (vec_id) GROUP BY ALL""")
def voice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One second skipped and five kept of two channels of four frames a second, as one channel of two."""
    sound = _sound(spark, sf_dir).withColumn("start", (F.col("start") / 2).cast("long"))
    rows = pcm.voice_sample(sound, "vec_id", "start", "samples", 4, 2, 1.0, 5.0, 2, frames=3)
    rows = rows.select("vec_id", "start", F.posexplode("samples").alias("i", "x"))
    return rows.select("vec_id", (F.col("start") + F.col("i")).alias("frame"), (F.round("x", 6) + 0).alias("sample"))


_O_PIECES = "SELECT {b} AS book_id, CAST(i AS BIGINT) AS piece_no, CAST(least(4096, length(h) // 2 - 4096 * i) AS BIGINT) AS n_bytes, md5(from_hex(substr(h, 8192 * i + 1, 8192))) AS digest FROM (SELECT {b}, h, unnest(range(0, (length(h) // 2 + 4095) // 4096)) AS i FROM h)"


@query("WITH h AS (SELECT source, string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS h FROM documents GROUP BY source) " + _O_PIECES.format(b="source"))
def stitched_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source one after the other, in pieces of 4 KB."""
    docs = _table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "text")
    return pcm.stitched_pieces(docs, "source", "name", "text", 4096).select(F.col("source").alias("book_id"), "piece_no", F.octet_length("payload").cast("long").alias("n_bytes"), F.md5("payload").alias("digest"))


@query(f"""WITH p AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS p, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n, 1 AS ch FROM conversations GROUP BY conv_id),
h AS (SELECT 'conv_id=' || conv_id AS book, hex({_O_WAV}) AS h FROM p) {_O_PIECES.format(b="book")}""")
def stitched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each conversation, a WAV file each, stitched to one WAV file, whose pieces are written as files and read again."""
    one = _table(spark, sf_dir, "conversations").select("conv_id", F.format_string("%04d.wav", "turn").alias("fname"), signal.wav(F.col("text").cast("binary"), 8000, 1).alias("content"))
    parts = fresh(spark, "parts")
    write_named(one, parts, ["conv_id"], "fname", "content")
    read = lambda at: read_named(spark, at).select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("book"), F.regexp_extract("path", "([^/]*)$", 1).alias("fname"), "content")
    whole = pcm.stitched_pieces(read(parts).withColumn("content", signal.wav_payload(F.col("content"))), "book", "fname", "content", 4096, 8000)
    at = fresh(spark, "stitched")
    write_named(whole.select(F.regexp_replace("book", "^conv_id=", "").alias("conv_id"), F.format_string("%06d", "piece_no").alias("fname"), "payload"), at, ["conv_id"], "fname", "payload", dealt=True)
    return read(at).select(F.col("book").alias("book_id"), F.col("fname").cast("long").alias("piece_no"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


_O_SOUND = """WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS device, string_agg(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), '' ORDER BY turn) AS p FROM conversations GROUP BY conv_id),
b AS (SELECT device, i, substr(p, {w} * i + 1, least({w}, 2 * (length(p) // 2) - {w} * i)) AS b FROM (SELECT device, p, unnest(range(0, (length(p) // 2 * 2 + {w} - 1) // {w})) AS i FROM p))
SELECT device, CAST(i AS BIGINT) AS block_no, CAST(length(b) // 2 AS BIGINT) AS n, md5(b) AS digest FROM b"""


def _recorded(spark: SparkSession, sf_dir: str, frames: int, run: Callable[[DataFrame, str], None]) -> None:
    """run(stream, checkpoint), first while the recordings (conversations, their printable ASCII letters as samples) are half there, and again, from the checkpoint, when they are over."""
    said = F.regexp_replace(tx.text_or_empty("text"), "[^ -~]", "")
    whole = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))), lambda x: x["t"]), "").alias("p"))
    whole = whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".pcm")).alias("name"), "p")
    half = whole.select("name", F.expr("substring(p, 1, cast(length(p) / 2 as int))").cast("binary").alias("content"))
    over = whole.select("name", F.col("p").cast("binary").alias("content")).unionByName(whole.select(F.concat("name", F.lit(".end")).alias("name"), F.lit(b"").alias("content")))
    state = fresh(spark, "sound-state")
    for files_there in (half, over):
        at = fresh(spark, "sound")
        write_named(files_there, at, [], "name", "content")
        run(sound_stream(spark, at, 8000, 1, frames), state)


@query(_O_SOUND.format(w=128))
def live_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings read while they grow, in blocks of 64 frames, by a stream that is started twice."""
    out = fresh(spark, "live")
    _recorded(spark, sf_dir, 64, lambda stream, state: files.write_clips(stream, out, state, availableNow=True).awaitTermination())
    rows = spark.read.schema("device string, start long, pcm binary").parquet(out).where("pcm is not null")
    return rows.select("device", F.floor(F.col("start") / 64).cast("long").alias("block_no"), F.floor(F.octet_length("pcm") / 2).cast("long").alias("n"), F.md5("pcm").alias("digest"))


@query(_O_SOUND.format(w=96))
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in blocks of 48 frames, made over the stream from blocks of 64."""
    out = fresh(spark, "live")

    def run(stream: DataFrame, state: str) -> None:
        files.write_clips(block_stream(stream, "device", "start", "pcm", 48), out, state, availableNow=True).awaitTermination()

    _recorded(spark, sf_dir, 64, run)
    rows = spark.read.schema("device string, block_no long, n long, level double, pcm binary").parquet(out)
    return rows.select("device", "block_no", "n", F.md5("pcm").alias("digest"))
