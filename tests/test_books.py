import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgate.operators import chapters as ch, chunks, lines as ln, manifest as mf
from leafgate.plans import book, engines
from leafgate.sources import files


def pages(spark, *rows):
    return spark.createDataFrame([("b", i, t) for i, t in enumerate(rows)], "book_id string, page_no int, text string")


def made(spark, *rows):
    return [(r["chapter_no"], r["title"], r["text"]) for r in ch.chapters(ln.strip_repeated(ln.lines(pages(spark, *rows)))).orderBy("chapter_no").collect()]


def test_front_matter_blank_bodies_and_null_pages(spark):
    assert made(spark, "x\nPart I\nChapter 1\n  a", None, "b\nChapter 2\n \n") == [(1, "Front Matter", "x\n"), (2, "Chapter 1", "  a\nb\n")]
    assert made(spark, "only\nbody") == [(1, "Front Matter", "only\nbody\n")]
    assert made(spark, "", None) == []


def test_a_heading_on_five_pages_goes_first(spark):
    rows = [f"Chapter 1\nt{i}" for i in range(5)]
    assert made(spark, *rows) == [(1, "Front Matter", "t0\nt1\nt2\nt3\nt4\n")]
    kept = ch.chapters(ln.strip_repeated(ln.lines(pages(spark, *rows)), keep_headings=True))
    assert kept.count() == 5
    assert len(made(spark, *rows[:4])) == 4


def test_repeated_lines_of_pages_are_those_of_lines(spark):
    rows = pages(spark, *(f"top\n twice \ntwice\n\nown {i}\n" + ("five" if i < 5 else "") + ("\nfour" if i < 4 else "") for i in range(6)), None, "")
    want = sorted(map(tuple, ln.repeated_lines(ln.lines(rows)).collect()))
    assert sorted(map(tuple, ln.repeated_of_pages(rows).collect())) == want == [("b", "five", 5), ("b", "top", 6), ("b", "twice", 6)]


def test_many_chapters_in_order(spark):
    got = made(spark, *(f"Chapter {i}\nbody {i}" for i in range(1, 131)))
    assert [g[1] for g in got] == [f"Chapter {i}" for i in range(1, 131)]


def test_manifest_and_stitching(spark):
    work = book.work(pages(spark, "Chapter 1\nA b c. D e.", "Chapter 2\nF."), "words", 2)
    assert [(r["fname"], r["n_chunks"]) for r in work.orderBy("chapter_no").collect()] == [("01_Chapter 1.mp3", 2), ("02_Chapter 2.mp3", 1)]
    done = spark.createDataFrame([("b", "01_Chapter 1.mp3")] * 2, "book_id string, fname string")
    assert [r["fname"] for r in mf.pending(work, done).collect()] == ["02_Chapter 2.mp3"]
    p = mf.progress(work, done).first()
    assert (p["n_items"], p["n_done"], p["n_chunks"], p["chunks_done"]) == (2, 1, 3, 2)
    names = spark.createDataFrame([("b", "11_x.mp3"), ("b", "100_x.mp3"), ("b", "09_x.mp3")], "book string, fname string")
    assert mf.stitched(names, "book").first()["files"] == "09_x.mp3|100_x.mp3|11_x.mp3"
    assert mf.stitched(names, "book", numeric=True).first()["files"] == "09_x.mp3|11_x.mp3|100_x.mp3"
    with pytest.raises(ValueError):
        book.work(pages(spark, "x"), "pages")


def test_one_name_in_two_books_is_done_in_one(spark):
    work = spark.createDataFrame([("a", "01_Chapter 1.mp3", 2), ("b", "01_Chapter 1.mp3", 3)], "book_id string, fname string, n_chunks long")
    done = spark.createDataFrame([("a", "01_Chapter 1.mp3")], "book_id string, fname string")
    assert [r["book_id"] for r in mf.pending(work, done).collect()] == ["b"]
    assert [r["book_id"] for r in mf.finished(work, done).collect()] == ["a"]
    got = {r["book_id"]: (r["n_items"], r["n_done"], r["chunks_done"]) for r in mf.progress(work, done).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 0)}


def test_settings():
    with pytest.raises(ValueError):
        book.Settings(size=0).checked()
    engines.register("small", engines.Settings(lambda voice: str.encode, "chars", 99))
    assert book.Settings(engine="small").checked().size == 99 and book.Settings(engine="small", size=5).checked().size == 5
    with pytest.raises(NotImplementedError):
        book.Settings(engine="unknown").checked()


def test_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.chapter_files(spark, str(tmp_path)).count()
    for read in (files.chapter_files, files.audio_files, files.stitched_folder, lambda s, f: files.extracted_pages(s, f, list)):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        files.stitched_folder(spark, str(tmp_path))
    names = ["b one é+50%.txt", "a.txt", "c d.txt", "10.txt", "9.txt"]
    for name in names:
        (tmp_path / name).write_text(f"two\nlines {name}", encoding="utf-8")
    (tmp_path / "x.mp3").write_bytes(b"123")
    got = files.chapter_files(spark, str(tmp_path)).orderBy("chapter_no").collect()
    assert [(r["chapter_no"], r["title"], r["text"]) for r in got] == [(i, n[:-4], f"two\nlines {n}") for i, n in enumerate(sorted(names), 1)]
    assert {r["book_id"] for r in got} == {tmp_path.name}
    assert [r["length"] for r in files.audio_files(spark, str(tmp_path)).collect()] == [3]
    got = files.extracted_pages(spark, str(tmp_path), lambda b: ["p1", None, str(len(b))], "*.mp3")
    assert [(r["folder"], r["book_id"], r["page_no"], r["text"]) for r in got.orderBy("page_no").collect()] == [(tmp_path.name, "x", 1, "p1"), (tmp_path.name, "x", 2, ""), (tmp_path.name, "x", 3, "3")]


def test_finished_outputs_and_stitching_of_folders(spark, tmp_path):
    for name in ("one/02_b.mp3", "one/10_c.mp3", "two/01_a.mp3", "one/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = files.finished_outputs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("one", "02_b.mp3"), ("one", "10_c.mp3"), ("two", "01_a.mp3")]
    whole = files.stitched_folder(spark, str(tmp_path / "one")).first()
    assert whole["files"] == "02_b.mp3|10_c.mp3" and whole["n_files"] == 2 and whole["output"].endswith("/one_full.mp3")


def test_manifests_are_written_by_book(spark, tmp_path):
    work = book.work(pages(spark, "Chapter 1\nA b c. D e.", "Chapter 2\nF."))
    files.write_manifest(work, str(tmp_path / "m"))
    assert [p.name for p in sorted((tmp_path / "m").glob("book_id=*"))] == ["book_id=b"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).select(*work.columns).collect())) == sorted(map(tuple, work.collect()))


def test_engines(spark):
    engines.register("echo", engines.Settings(lambda voice: lambda s: (voice + s).encode(), needs_voice=True))
    rows = spark.createDataFrame([("b", 1, 0, "x")], "book_id string, chapter_no int, chunk_no int, chunk string")
    assert bytes(engines.synthesised(rows, "echo", "v").first()["audio"]) == b"vx"
    with pytest.raises(ValueError):
        engines.settings("echo")
    with pytest.raises(NotImplementedError):
        engines.settings("other")


def test_transcript_lines(spark, tmp_path):
    from leafgate.operators.transcript import transcript_lines

    rows = spark.sql("select 1 as id, 0 as segment_no, 0.26D as start, 1.5D as end, ' hi ' as text, array(struct(cast(null as double) as start, 'a' as word), struct(12.5D as start, 'b' as word)) as words union all select 1, 1, 2D, 3D, 'x', null")
    out = transcript_lines(rows, "id")
    assert [r["line"] for r in out.orderBy("segment_no", "word_no").collect()] == ["\n[0.3s — 1.5s]  hi", "           ?  a", "      12.50s  b", "\n[2.0s — 3.0s]  x"]
    for key in (1, 2):
        files.write_transcript(out.unionByName(out.withColumn("id", F.lit(2))), str(tmp_path / "t"), "id")
        (own,) = (tmp_path / "t" / f"id={key}").glob("part-*")  # one file for each key, in order
        assert own.read_text() == "\n[0.3s — 1.5s]  hi\n           ?  a\n      12.50s  b\n\n[2.0s — 3.0s]  x\n"


def test_transcripts_of_a_recogniser(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"segments": [{"start": 0.5, "end": 1.0, "text": "x", "words": [{"word": "x"}]}, {"start": 1.0, "end": 2.0, "text": "y"}]}')
    (tmp_path / "b.json").write_text('{"segments": []}')
    got = files.transcripts(spark, str(tmp_path)).orderBy("segment_no").collect()
    assert [(r["segment_no"], r["text"], r["words"] and r["words"][0]["start"]) for r in got] == [(0, "x", None), (1, "y", None)]


def test_texts_of_a_batch_are_taken_apart_some_at_a_time(monkeypatch):
    texts = ["One. Two. " * 300, None, "", "Three!"] * 5
    monkeypatch.setattr(chunks, "PART_CHARS", 4000)
    parts = list(chunks._parts(pa.array(texts)))
    assert [t for p in parts for t in p] == texts and len(parts) == 3
    assert all(sum(len(t or "") for t in p[:-1]) < 4000 for p in parts)


@pytest.mark.parametrize("chunked, counted, size", [(chunks.by_words, chunks.n_by_words, 7), (chunks.by_chars, chunks.n_by_chars, 30)])
def test_chunks_are_counted_without_being_sent(spark, chunked, counted, size):
    rows = spark.createDataFrame([(t,) for t in ("", None, "One two. Three four five! Six? " * 40, " . ", "word " * 50)], "text string")
    both = rows.select(F.size(chunked(F.col("text"), size)).alias("a"), counted(F.col("text"), size).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and max(r["a"] for r in both) > 10
