"""Resampling, stitching, recordings that grow and blocks over a stream, against plain numpy and bytes."""

import io
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgate.functions.signal import wav, wav_payload
from leafgate.operators import pcm
from leafgate.sources.files import write_clips
from leafgate.sources.live import TASK_BYTES, _Reader, data_start, sound_stream
from leafgate.streaming.blocks import block_stream


def plain(x, rate, to):
    """Every result as the weighted sum over the whole signal."""
    cut = min(1.0, to / rate)
    m = np.arange(-(-len(x) * to // rate))
    return (pcm.kernel(m[:, None] * rate / to - np.arange(len(x)), cut) * x).sum(1)


def whole(rows, key="k"):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (str(r[key]), r["start"])):
        have = out.setdefault(r[key], [])
        assert r["start"] == len(have)
        have += r["samples"]
    return out


@pytest.mark.parametrize("rate, to", [(44100, 22050), (22050, 44100), (44100, 48000), (7, 5), (8000, 8000)])
def test_blocks_resampled_alone_equal_the_whole_signal(spark, rate, to):
    rng = np.random.default_rng(rate + to)
    signals = {"a": rng.normal(size=1000), None: rng.normal(size=37), "one": np.ones(1)}
    rows = []
    for k, x in signals.items():
        cuts = [0, *sorted(rng.integers(0, len(x) + 1, 4).tolist()), len(x)]
        rows += [(k, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    rows.append(("nothing", 0, None))
    random.Random(1).shuffle(rows)
    blocks = spark.createDataFrame(rows, "k string, start long, samples array<double>").repartition(3)
    got = whole(pcm.resampled(blocks, "k", "start", "samples", rate, to, frames=64))
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], plain(x, rate, to), atol=1e-9)
    assert pcm.resampled(blocks.limit(0), "k", "start", "samples", rate, to).count() == 0


def test_thousands_of_short_blocks_are_made_in_few_calls(spark):
    """Over more than one Arrow batch, and with groups that go on in the next one."""
    rng = np.random.default_rng(8)
    signals = {k: rng.normal(size=97) for k in range(150)}
    rows = [(k, i, x[i : i + 3].tolist()) for k, x in signals.items() for i in range(0, 97, 3)]
    blocks = spark.createDataFrame(rows, "k long, start long, samples array<double>").coalesce(2)
    made = pcm.resampled(blocks, "k", "start", "samples", 32000, 48000, frames=8)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = whole(made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        np.testing.assert_allclose(got[k], plain(x, 32000, 48000), atol=1e-9)


def test_a_tone_keeps_its_level_and_what_is_above_the_band_goes(spark):
    t = np.arange(8000) / 44100
    for hertz, level in ((1000, 1.0), (18000, 0.0)):
        x = np.sin(2 * np.pi * hertz * t)
        blocks = spark.createDataFrame([("k", i, x[i : i + 1000].tolist()) for i in range(0, 8000, 1000)], "k string, start long, samples array<double>")
        y = np.array(whole(pcm.resampled(blocks, "k", "start", "samples", 44100, 22050, frames=512))["k"])[200:-200]
        assert abs(np.sqrt(2 * np.mean(y**2)) - level) < 0.02


def test_voice_sample_skips_mixes_and_resamples(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, 2 * 900)
    blocks = spark.createDataFrame([("k", i, x[2 * i : 2 * i + 140].tolist()) for i in range(0, 900, 70)] + [("short", 0, [1, 2, 3])], "k string, start long, samples array<int>")
    got = whole(pcm.voice_sample(blocks, "k", "start", "samples", 100, 2, 3.0, 4.0, 50, frames=33))
    assert got.keys() == {"k"}
    np.testing.assert_allclose(got["k"], plain(x.reshape(-1, 2).mean(1)[300:700], 100, 50), atol=1e-9)


def test_mono_drops_unfinished_frames(spark):
    rows = spark.createDataFrame([([1, 3, 5, None, 7],), ([],), (None,), ([4],)], "x array<int>")
    assert [r[0] for r in rows.select(pcm.mono(F.col("x"), 2)).collect()] == [[2.0, 2.5], [], [], []]
    assert [r[0] for r in rows.select(pcm.mono(F.col("x"), 1)).collect()] == [[1.0, 3.0, 5.0, 0.0, 7.0], [], [], [4.0]]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_pieces_are_the_files_in_the_order_of_names(spark, piece):
    rng = random.Random(piece)
    files = [(b, f"{i:03}", rng.choice([None, b"", rng.randbytes(rng.randint(1, 40))])) for b in ("x", None, "é") for i in range(25)] + [("empty", "0", None)]
    rows = spark.createDataFrame(rng.sample(files, len(files)), "b string, f string, c binary").repartition(3)
    got = {}
    for r in sorted(pcm.stitched_pieces(rows, "b", "f", "c", piece).collect(), key=lambda r: r["piece_no"]):
        have = got.setdefault(r["b"], b"")
        assert len(have) == r["piece_no"] * piece and 0 < len(r["payload"]) <= piece
        got[r["b"]] = have + bytes(r["payload"])
    assert got == {b: b"".join(c or b"" for k, _, c in files if k == b) for b in ("x", None, "é")}


def test_stitched_wav_opens_as_such(spark):
    parts = [("b", "0.wav", b"\x01\x02\x03\x04"), ("b", "1.wav", b""), ("b", "2.wav", b"\x05\x06\x07"), ("none", "0.wav", b"")]
    rows = spark.createDataFrame(parts, "b string, f string, c binary").withColumn("c", wav_payload(wav(F.col("c"), 8000, 1)))
    got = {}
    for r in sorted(pcm.stitched_pieces(rows, "b", "f", "c", 20, 8000).collect(), key=lambda r: r["piece_no"]):
        got[r["b"]] = got.get(r["b"], b"") + bytes(r["payload"])
    for b, sound in (("b", bytes(range(1, 8))), ("none", b"")):
        assert len(got[b]) == 44 + len(sound) + len(sound) % 2
        with wave.open(io.BytesIO(got[b])) as w:
            assert (w.getframerate(), w.getnchannels(), w.getnframes()) == (8000, 1, len(sound) // 2)


def test_recordings_are_read_while_they_grow(spark, tmp_path):
    sound, at = random.Random(2).randbytes(4 * 1000), tmp_path / "in"
    at.mkdir()
    head = bytes(spark.range(1).select(wav(F.lit(b""), 8000, 2)).first()[0])
    assert data_start(head) == 44 and data_start(head[:40]) is None

    def run():
        write_clips(sound_stream(spark, str(at), 8000, 2, 64), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
        return sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r["device"], r["start"], r["pcm"] is None))

    (at / "mic_20240131_235959.pcm").write_bytes(sound[:1001])
    (at / "line.wav").write_bytes(head[:30])
    (at / "notes.txt").write_bytes(b"no sound")
    assert [(r["device"], r["start"], len(r["pcm"])) for r in run()] == [("mic_20240131_235959", 64 * i, 256) for i in range(3)]
    (at / "mic_20240131_235959.pcm").write_bytes(sound[:3999])
    (at / "line.wav").write_bytes(head + sound)
    (at / "line.wav.end").touch()
    assert len([r for r in run() if r["device"] == "line"]) == 17
    (at / "mic_20240131_235959.pcm.end").touch()
    run()
    rows = run()  # nothing new
    for device, n in (("line", 1000), ("mic_20240131_235959", 999)):
        mine = [r for r in rows if r["device"] == device]
        assert b"".join(bytes(r["pcm"] or b"") for r in mine) == sound[: 4 * n]
        assert [r["start"] for r in mine] == [*range(0, n, 64), n] and mine[-1]["pcm"] is None
    assert rows[-1]["ts"] - [r for r in rows if r["device"].startswith("mic")][0]["ts"] == np.timedelta64(999_000_000 // 8000, "us").item()


def test_rows_of_any_length_order_and_number_become_blocks(spark, tmp_path):
    rng = random.Random(3)
    sounds = {"a": rng.randbytes(4 * 333), "b": rng.randbytes(4 * 128), "open": rng.randbytes(4 * 70), "none": b""}
    rows = []
    for k, x in sounds.items():
        cuts = [0, *sorted(rng.sample(range(1, len(x) // 4), 12)), len(x) // 4] if x else [0]
        rows += [(k, s, x[4 * s : 4 * e]) for s, e in zip(cuts, cuts[1:])]
        if k != "open":
            rows.append((k, len(x) // 4, None))
    rows += rng.sample(rows, 10) + [("a", 50, sounds["a"][200:500]), ("a", None, b"1234")]
    rng.shuffle(rows)
    schema = "k string, start long, pcm binary"
    for i in range(0, len(rows), 18):
        spark.createDataFrame(rows[i : i + 18], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_clips(block_stream(stream, "k", "start", "pcm", 32, 2), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = sorted(tuple(r[c] if c != "pcm" else bytes(r[c]) for c in ("k", "block_no", "n", "pcm")) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for k, x in sounds.items():
        blocks = [x[i : i + 128] for i in range(0, len(x) // 128 * 128 if k == "open" else len(x), 128)]
        want += [(k, i, len(b) // 4, b) for i, b in enumerate(blocks)]
    assert got == sorted(want)


def test_many_short_recordings_share_a_task_and_a_long_one_has_many():
    reader = _Reader({"path": "/none", "channels": "1", "frames": "64", "span": "4096"})
    end = {f"{i}.pcm": [640, 1] for i in range(2000)} | {"long.pcm": [(64 << 20) // 2, 0]}
    tasks = reader.partitions({"3.pcm": [64, 0], "4.pcm": [640, 1]}, end)
    assert 17 <= len(tasks) < 40  # one for each recording, and one for each end, before
    assert all(sum(2 * (r.high - r.low) for r in t.ranges) <= TASK_BYTES for t in tasks)
    got = {}
    for r in (r for t in tasks for r in t.ranges):
        got.setdefault(r.name, []).append((r.low, r.high, r.over))
    assert "4.pcm" not in got and got["3.pcm"] == [(64, 640, False), (640, 640, True)] and got["5.pcm"] == [(0, 640, False), (640, 640, True)]
    assert [a for a, _, _ in got["long.pcm"]] == [0, *(b for _, b, _ in got["long.pcm"][:-1])] and got["long.pcm"][-1][1] == (64 << 20) // 2


def test_blocks_are_made_of_rows_without_pandas(spark, tmp_path):
    """A frame for each device and micro-batch, in and out, cost more than the blocks."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k long, start long, pcm binary").parquet(str(tmp_path / "in"))
    plan = block_stream(stream, "k", "start", "pcm", 8)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" in plan and "InPandas" not in plan


def test_blocks_of_odd_rows_and_null_devices(spark, tmp_path):
    """Null devices are one recording; empty, repeated, longer and late rows; an end before what has come; levels of long and short blocks."""
    rng = random.Random(5)
    x = rng.randbytes(2 * 100_000)
    runs = [
        [(None, 0, x[:100]), (None, 0, x[:60]), (1, 8, x[16:40]), (1, 0, b""), (2, 0, x), (2, 100_000, None), (3, 0, x[:80]), (3, 12, None), (4, None, x)],
        [(None, 50, x[100:101]), (None, 50, x[100:122]), (1, 0, x[:17]), (1, 8, x[16:30]), (2, 5, x), (3, 40, x[80:100])],
    ]
    for rows in runs:
        spark.createDataFrame(rows, "k long, start long, pcm binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, start long, pcm binary").parquet(str(tmp_path / "in"))
        write_clips(block_stream(stream, "k", "start", "pcm", 8), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["block_no"]):
        samples = np.frombuffer(r["pcm"], "<i2").astype(float)
        assert r["n"] == len(samples) and r["level"] == np.sqrt(np.mean(np.square(samples)))
        got.setdefault(r["k"], []).append((r["block_no"], bytes(r["pcm"])))
    want = {None: (x[:112], 56), 1: (x[:32], 16), 2: (x, 100_000), 3: (x[:24], 12)}
    assert got == {k: [(i, s[16 * i : 16 * (i + 1)]) for i in range(-(-n // 8))] for k, (s, n) in want.items()}


@pytest.mark.parametrize("n", [3, 4])
def test_header_and_pad_read_the_files_once(spark, n):
    """A source that Spark cannot tell to be the same is read again by each branch of a plan: for contents, places and sums, and not for the pad alone."""
    rows = spark.createDataFrame([("b", "1", bytes(n)), (None, None, b"x"), ("none", "1", None)], "b string, f string, c binary")
    out = pcm.stitched_pieces(rows, "b", "f", "c", 1000, 8000)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    got = {r["b"]: bytes(r["payload"]) for r in out.collect()}
    whole = lambda c: bytes(spark.range(1).select(wav(F.lit(c), 8000, 1)).first()[0])
    assert got == {"b": whole(bytes(n)), None: whole(b"x"), "none": whole(b"")}
