"""Named files and WAV."""

import io
import wave

import pytest
from pyspark.sql import functions as F

from leafgate.functions.signal import wav
from leafgate.queries import QUERIES
from leafgate.sources import files as sources, named
from leafgate.sources.named import read_named, write_batch, write_named

ROWS = "k string, n string, c binary"


def files(at):
    return {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file()}


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a b", "1.wav", b"xy"), ("a b", "2.wav", None), ("é/", "1.wav", b"\x00z")], ROWS).repartition(3)
    write_named(rows, str(tmp_path / "out"), ["k"], "n", "c")
    assert files(tmp_path / "out") == {"k=a b/1.wav": b"xy", "k=a b/2.wav": b"", "k=%C3%A9%2F/1.wav": b"\x00z"}
    with pytest.raises(Exception):  # the target is there
        write_named(rows, str(tmp_path / "out"), ["k"], "n", "c")
    many = spark.range(40).select(F.lit("k").alias("k"), F.concat(F.col("id").cast("string"), F.when(F.col("id") == 37, "/").otherwise(".wav")).alias("n"), F.lit(b"1").alias("c")).repartition(4)
    with pytest.raises(Exception, match="no name"):
        write_named(many, "file://" + str(tmp_path / "failed"), ["k"], "n", "c")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    write_named(rows.limit(0), str(tmp_path / "none"), ["k"], "n", "c")
    assert files(tmp_path / "none") == {}


def test_a_batch_that_comes_again_writes_nothing(spark, tmp_path):
    at = str(tmp_path / "clips")
    one = spark.createDataFrame([("a", "1.wav", b"x")], ROWS)
    assert write_batch(one, 0, at, [], "n", "c") and not write_batch(one, 0, at, [], "n", "c")
    assert write_batch(one, 1, at, [], "n", "c")
    assert sorted(files(tmp_path / "clips")) == ["batch=0/1.wav", "batch=1/1.wav"]


def test_a_stream_killed_between_its_files_and_its_checkpoint_gives_each_clip_once(spark, tmp_path):
    spark.createDataFrame([("a", "1.wav", b"x"), ("b", "2.wav", b"y")], ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    fail, wrote = [True], []

    def sink(rows, batch):
        wrote.append(write_batch(rows, batch, str(tmp_path / "out"), ["k"], "n", "c"))
        if fail.pop() if fail else False:
            raise RuntimeError("killed")

    def run():
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert wrote == [True, False]
    assert sorted(files(tmp_path / "out")) == ["batch=0/k=a/1.wav", "batch=0/k=b/2.wav"]


@pytest.mark.parametrize("pcm, rate, channels", [(b"\x01\x02\x03\x04", 8000, 1), (b"", 44100, 2), (b"\x00" * 400_000, 48000, 2), (b"abc", 22050, 1)])
def test_wav_opens_as_such(spark, pcm, rate, channels):
    made = bytes(spark.createDataFrame([(pcm, rate, channels)], "p binary, r int, c int").select(wav(F.col("p"), F.col("r"), F.col("c"))).first()[0])
    with wave.open(io.BytesIO(made)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()) == (rate, channels, 2, len(pcm) // (2 * channels))
        assert w.readframes(1 << 30) == pcm
    assert len(made) == 44 + len(pcm) + len(pcm) % 2


def test_many_folders_are_written_and_read_by_a_fixed_number_of_tasks(spark, tmp_path):
    rows = spark.range(300).coalesce(1).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("a.txt").alias("n"), F.col("id").cast("string").cast("binary").alias("c"))
    for _ in range(2):  # the second replaces the first
        write_named(rows, str(tmp_path / "out"), ["k"], "n", "c", replace=True)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    (tmp_path / "out" / "_hidden").write_text("x")
    (tmp_path / "out" / "plain.txt").write_text("xy")
    found = read_named(spark, str(tmp_path / "out"))
    assert found.rdd.getNumPartitions() == named.TASKS < 300
    got = {r["path"][len(str(tmp_path)) + 5 :]: (r["length"], bytes(r["content"])) for r in found.collect()}
    want = {f"k={i or named.NULL}/a.txt": (len(str(i)), str(i).encode()) for i in range(300)}
    assert got == {**want, "plain.txt": (2, b"xy")}


def test_files_of_one_task_are_written_by_all(spark, tmp_path):
    rows = spark.range(300).coalesce(1).select(F.col("id").alias("k"), F.lit("a").alias("n"), F.lit(b"x").alias("c"))
    write_named(rows, str(tmp_path / "out"), ["k"], "n", "c")
    plan = named._dealt(rows)._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan and named._dealt(rows).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_transcripts_of_very_many_files_are_those_of_sparks_reader(spark, tmp_path):
    for i, said in enumerate(['{"segments": [{"start": 0.5, "end": 1.0, "text": "x", "words": [{"word": "é"}]}, null, {"text": "y"}]}', '{"segments": []}', "{}", "[]", "no json", '[{"segments": [{"text": "a"}]}, {"segments": [{"text": "b"}]}]']):
        (tmp_path / f"k={i}").mkdir()
        (tmp_path / f"k={i}" / "a.json").write_text(said)
    rows = [sorted(map(str, (r.asDict(True) | {"path": r["path"].split("/")[-2]} for r in x.collect()))) for x in (sources.transcripts(spark, str(tmp_path), recursive=True), sources.many_transcripts(spark, str(tmp_path)))]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_rows_that_a_shuffle_has_dealt_are_not_dealt_again(spark, tmp_path, sf, monkeypatch):
    """The pieces of stitched files come from a shuffle by book and piece; only the parts, as they come from the table, are dealt."""
    calls, deal = [], named._dealt
    monkeypatch.setattr(named, "_dealt", lambda rows: calls.append(rows.columns) or deal(rows))
    rows = spark.createDataFrame([("a", 1, b"x"), ("b", 2, None), (None, 3, b"")], "k string, no long, c binary").repartition(3, "k")
    write_named(rows.select("k", F.col("no").cast("string").alias("f"), "c"), f"{tmp_path}/out", ["k"], "f", "c", dealt=True)
    got = {(r["path"].rpartition("/out/")[2], bytes(r["content"])) for r in read_named(spark, f"{tmp_path}/out").collect()}
    assert got == {("k=a/1", b"x"), ("k=b/2", b""), ("k=__HIVE_DEFAULT_PARTITION__/3", b"")} and not calls
    assert QUERIES["stitched_files"](spark, sf).count()
    assert calls == [["conv_id", "fname", "content"]]
