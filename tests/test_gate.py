import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafgate.functions.signal import pcm_rms, rms
from leafgate.operators.gate import clip_audio, gate_blocks, gate_clips, long_enough
from leafgate.sources.files import block_stream, write_clips
from leafgate.streaming.gate import drain, gate_stream

T0 = datetime(2024, 1, 1)


def machine(blocks, level=200, gap=4.0):
    """The gate, a block at a time: (start, end, blocks, closed)."""
    out, start, silent, n, last = [], None, None, 0, None
    for t, x in blocks:
        if x >= level:
            if start is None:
                start, n = t, 0
            silent, n, last = None, n + 1, t
        elif start is not None:
            n, last = n + 1, t
            silent = t if silent is None else silent
            if t - silent >= gap:
                out.append((start, t, n, True))
                start = silent = None
    return out + ([(start, last, n, False)] if start is not None else [])


def frame(spark, keys):
    rows = [(k, i, T0 + timedelta(seconds=t), float(x)) for k, b in keys.items() for i, (t, x) in enumerate(b)]
    return spark.createDataFrame(rows, "k long, event long, ts timestamp, level double")


def batch(spark, keys):
    out = gate_clips(frame(spark, keys), "k", ["ts", "event"], "ts", F.col("level")).collect()
    sec = lambda x: (x - T0).total_seconds()
    return sorted((r["k"], sec(r["start_ts"]), sec(r["end_ts"]), r["n_blocks"], r["closed"]) for r in out)


def test_edges(spark):
    keys = {
        1: [(0, 200), (1, 199), (5, 0), (6, 0), (7, 300)],  # exactly level, exactly gap, an audible end
        2: [(0, 0), (1, 0)],
        3: [(0, 300), (10, 0), (13.999, 0), (14, 0)],
    }
    assert batch(spark, keys) == [(1, 0, 5, 3, True), (1, 7, 7, 1, False), (3, 0, 14, 4, True)]


def test_batch_equals_machine(spark):
    rng = random.Random(5)
    keys = {}
    for k in range(8):
        t, keys[k] = 0.0, []
        for _ in range(120):
            t += rng.choice([0.5, 1, 2, 4])
            keys[k].append((t, rng.choice([0, 0, 100, 200, 900])))
    assert batch(spark, keys) == sorted((k, *c) for k, b in keys.items() for c in machine(b))


def test_spans_of_a_hot_device_equal_the_machine(spark):
    """One device has nine tenths of the blocks; whatever the spans, the clips are those of the machine, and the device is no single task."""
    rng = random.Random(17)
    keys = {}
    for k, n in ((0, 3000), (1, 150), (2, 150), (3, 1), (4, 0)):
        t, keys[k] = 0.0, []
        for _ in range(n):
            t += rng.choice([0.0, 0.25, 0.5, 1, 2, 4, 30] if rng.random() < 0.98 else [200])
            keys[k].append((t, rng.choice([0, 0, 0, 100, 200, 900] if rng.random() < 0.7 else [0])))
    want = sorted((k, *c) for k, b in keys.items() for c in machine(b))
    blocks = frame(spark, keys)
    sec = lambda x: (x - T0).total_seconds()
    for span in (1, 7, 60, 1e9):
        out = gate_clips(blocks, "k", ["ts", "event"], "ts", F.col("level"), span=span).collect()
        assert sorted((r["k"], sec(r["start_ts"]), sec(r["end_ts"]), r["n_blocks"], r["closed"]) for r in out) == want
        for k in keys:
            own = sorted((r["start_ts"], r["end_ts"], r["clip_no"]) for r in out if r["k"] == k)
            assert [c for *_, c in own] == list(range(1, len(own) + 1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = gate_blocks(blocks, "k", ["ts", "event"], "ts", F.col("level"), span=60)
    parts = rows.where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4


def test_devices_and_times_may_be_null_and_blocks_without_a_level_are_none(spark):
    rows = [(None, 1, T0, 900.0), (None, 2, T0 + timedelta(seconds=9), 900.0), (5, 1, None, 900.0), (5, 2, T0, 900.0), (5, 3, T0, None)]
    blocks = spark.createDataFrame(rows, "k long, event long, ts timestamp, level double")
    got = {r["k"]: (r["clip_no"], r["n_blocks"]) for r in gate_clips(blocks, "k", ["ts", "event"], "ts", F.col("level")).collect()}
    assert got == {None: (1, 2), 5: (1, 2)}
    assert gate_clips(blocks.limit(0), "k", ["ts", "event"], "ts", F.col("level")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    keys = {k: [(i * 1.5, rng.choice([0, 0, 0, 500])) for i in range(80)] for k in range(3)}
    rows = frame(spark, keys)
    for part in range(4):
        lo, hi = T0 + timedelta(seconds=30 * part), T0 + timedelta(seconds=30 * (part + 1))
        rows.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gate_stream(stream, "k", "ts", "event", "level", least=0, late="1 day").writeStream.format("memory").queryName("clips").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], r["start_ts"], r["end_ts"], r["n_blocks"]) for r in spark.table("clips").collect())
    all_clips = gate_clips(rows, "k", ["ts", "event"], "ts", F.col("level"))
    assert got == sorted((r["k"], r["start_ts"], r["end_ts"], r["n_blocks"]) for r in all_clips.where("closed").collect())
    assert drain(rows, "k", ["ts", "event"], "ts", "level").count() == long_enough(all_clips.where("not closed")).count()


def test_streams_of_named_devices_end_and_drop_short_clips(spark, tmp_path):
    blocks = {"mic α": [(0, 900), (1, 0), (5, 0), (6, 900), (7, 0)], "mic β": [(0, 900), (1, 900)], "mic γ": [(0, 900), (3, 900), (3.5, 0)], "δ": [(0, 900), (9, 900)]}
    rows = [(k, i, T0 + timedelta(seconds=t), float(x)) for k, b in blocks.items() for i, (t, x) in enumerate(b)]
    rows += [(k, 99, T0 + timedelta(seconds=60), None) for k in blocks if k != "δ"]  # the streams of all but one end
    frame = spark.createDataFrame(rows, "device string, event long, ts timestamp, level double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = block_stream(spark, str(tmp_path / "in"), frame.schema)
    query = write_clips(gate_stream(stream, "device", "ts", "event", "level", late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    sec = lambda x: (x - T0).total_seconds()
    got = sorted((r["key"], r["clip_no"], sec(r["start_ts"]), sec(r["end_ts"]), r["n_blocks"], r["closed"]) for r in out.collect())
    assert got == [("mic α", 1, 0, 5, 3, True), ("mic γ", 1, 0, 3.5, 3, False)]  # 6 to 7 and all of β are short, δ is still open
    again = write_clips(gate_stream(stream, "device", "ts", "event", "level", late="1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    again.awaitTermination()
    assert out.count() == 2  # each clip once


def test_audio_of_clips(spark):
    rows = [("a", 1, i, p, 8000, 1 + (i > 0)) for i, p in enumerate([b"\x01\x02", b"", None, b"\x03\x00"])] + [("b", 1, 0, None, 44100, 2)]
    frame = spark.createDataFrame(rows, "k string, clip_no long, pos int, pcm binary, rate int, ch int")
    got = {r["k"]: r for r in clip_audio(frame, "k", ["pos"], "pcm", "rate", "ch").collect()}
    a, b = got["a"], got["b"]
    assert (bytes(a["payload"]), a["n_bytes"], a["rate"], a["channels"], a["seconds"]) == (b"\x01\x02\x03\x00", 4, 8000, 1, 4 / 16000)
    assert (bytes(b["payload"]), b["n_bytes"], b["rate"], b["channels"], b["seconds"]) == (b"", 0, 44100, 2, 0)


def test_levels(spark):
    row = spark.sql("select cast(array() as array<smallint>) as e, array(cast(-32768 as smallint), cast(32767 as smallint)) as s, X'0080FF7F' as b, X'' as z").select(rms(F.col("e")), rms(F.col("s")), pcm_rms(F.col("b")), pcm_rms(F.col("z"))).first()
    assert row[0] == 0 and abs(row[1] - row[2]) < 1e-9 and abs(row[1] - 32767.5) < 0.1 and row[3] == 0
