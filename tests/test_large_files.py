"""Files of any size are written and read some MB at a time."""

import hashlib
import itertools
from pathlib import Path

from pyspark.sql import functions as F

from leafgate import queries
from leafgate.sources import files
from leafgate.sources.named import write_named
from tests.compare import same


def test_pages_of_opened_files_are_sent_on_before_the_last_one(spark, tmp_path):
    sent = files._batched(itertools.repeat("x" * 1000), "f", "b")  # a file without an end
    first, second = next(sent), next(sent)
    assert len(first) <= files.SENT_ROWS and first["text"].str.len().sum() <= files.SENT_CHARS + 1000
    assert second["page_no"].iat[0] == len(first) + 1
    texts = ["one é", "", "two\nlines", "é" * 99, ""]
    for name, said in (("50% é+.txt", "".join(t + "\f" for t in texts)), ("open.txt", "a\fb"), ("empty.txt", "")):
        (tmp_path / name).write_text(said, encoding="utf-8", newline="")
    got = files.extracted_pages(spark, str(tmp_path), lambda f: files.parted(f, b"\f", 3), "*.txt", opened=True)
    assert [(r["book_id"], r["page_no"], r["text"]) for r in got.orderBy("book_id", "page_no").collect()] == [("50% é+", i, t) for i, t in enumerate(texts, 1)] + [("open", 1, "a"), ("open", 2, "b")]
    got = files.extracted_pages(spark, str(tmp_path), lambda f: [f.seek(0, 2)] and [str(f.tell())], "o*.txt", opened=True)  # from any place
    assert [r["text"] for r in got.collect()] == ["3"]
    assert [r["text"] for r in files.extracted_pages(spark, str(tmp_path), lambda b: [b.decode()], "50*.txt").collect()] == ["".join(t + "\f" for t in texts)]


def test_books_are_written_text_by_text(spark, tmp_path):
    rows = [(i, None if i == 3 else f"t{i}", "a/b + c") for i in (5, 3, 40, 1)] + [(2, "x", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    at = Path(queries._books(spark, str(tmp_path)).removeprefix("file://"))
    assert sorted(p.read_bytes() for p in at.glob("source=*/*.txt")) == [b"t1\f\ft5\ft40\f", b"x\f"]
    assert same(spark, str(tmp_path), queries.extracted_pages, queries.ORACLES["extracted_pages"]) == 5


def test_chapters_in_pieces_are_the_whole_files(spark, tmp_path):
    texts = {"one/a b+50%.txt": "é\n" * 7, "one/c.txt": "", "two/a.txt": "x", "é/b.txt": "ends in é"}
    for name, said in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(said, encoding="utf-8", newline="")
    whole = files.chapter_files(spark, str(tmp_path), recursive=True).collect()
    pieces = files.chapter_files(spark, str(tmp_path), recursive=True, piece_bytes=2)
    found = {}
    for r in pieces.collect():  # in order, in one task
        own = found.setdefault((r["path"], r["book_id"], r["chapter_no"], r["title"]), [])
        assert r["piece"] == len(own)
        own.append(r["text"])
    assert {k: "".join(v) for k, v in found.items()} == {tuple(r)[:4]: r["text"] for r in whole} and len(found) == 3  # Spark lists no empty files
    assert max(len(v) for v in found.values()) > 9
    got = {tuple(r)[:4]: r["digest"] for r in files.digests(pieces).collect()}
    assert got == {tuple(r)[:4]: hashlib.md5(r["text"].encode()).hexdigest() for r in whole}


def test_a_named_file_of_many_rows_is_written_row_by_row(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), F.format_string("%d.txt", F.col("id") % 2).alias("n"), (400 - F.col("id")).alias("at"), F.concat(F.col("id").cast("string"), F.lit(" ")).cast("binary").alias("c")).repartition(5)
    write_named(rows, str(tmp_path / "out"), ["k"], "n", "c", order=["at"])
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {f"k={k}/{n}.txt": "".join(f"{i} " for i in range(399, -1, -1) if (i % 3, i % 2) == (k, n)) for k in range(3) for n in range(2)}


def test_chapters_are_never_one_string(spark, sf, monkeypatch):
    aggregated = []
    monkeypatch.setattr(F, "expr", lambda s, real=F.expr: aggregated.append("listagg" in s) or real(s))
    for name in ("chapter_files", "chapter_folders", "finished_outputs"):
        assert same(spark, sf, queries.QUERIES[name], queries.ORACLES[name]) > 0
    assert not any(aggregated)


def test_names_of_books_come_back_as_they_were(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(["a/b + c", "50%", "plain"] * 4)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("chapter_files", "chapter_folders"):
        assert same(spark, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name]) == 12
