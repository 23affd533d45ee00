"""The gate over streams out of order: against the batch gate and the state machine."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from leafgate.operators.gate import gate_clips, long_enough
from leafgate.sources.files import block_stream, write_clips
from leafgate.streaming.ordered import ordered_gate_stream
from tests.test_gate import T0, frame

SCHEMA = "k long, event long, ts timestamp, level double"


def ran(spark, folder, batches, **options):
    """Each batch is a file of its own and one run of the stream, which goes on where the last one ended. Clips, and rows left in the state."""
    for batch in batches:
        rows = [(k, e, None if t is None else T0 + timedelta(seconds=t), x) for k, e, t, x in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = block_stream(spark, str(folder / "in"), SCHEMA)
        query = write_clips(ordered_gate_stream(stream, "k", "ts", "event", "level", least=0, **options), str(folder / "out"), str(folder / "cp"), availableNow=True)
        query.awaitTermination()
        assert query.exception() is None
    state = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    sec = lambda x: (x - T0).total_seconds()
    out = spark.read.parquet(str(folder / "out")).collect()
    return sorted((r["key"], r["clip_no"], sec(r["start_ts"]), sec(r["end_ts"]), r["n_blocks"], r["closed"]) for r in out), state


def test_shuffled_batches_equal_the_batch_gate_and_late_rows_change_nothing(spark, tmp_path):
    rng = random.Random(3)
    keys = {k: [(i * 1.5 + k / 10, float(rng.choice([0, 0, 0, 0, 500]))) for i in range(120)] for k in range(3)}
    blocks = [(k, i, t, x) for k, b in keys.items() for i, (t, x) in enumerate(b)]
    blocks += [(k, 999, 200.0, None) for k in keys]  # the ends of the streams
    batches = [[] for _ in range(5)]
    for b in blocks:
        batches[min(4, int(b[2] // 50) + rng.randint(0, 1))].append(b)  # up to 50 seconds and a batch late
    for b in batches:
        rng.shuffle(b)
    batches.append([(9, 1, 1000.0, None)])  # moves the watermark on
    batches.append([(k, 1, 30.0, 900.0) for k in keys] + [(0, 5, None, 900.0)])  # far too late, and without a time
    batches.append([(9, 2, 2000.0, None)])
    got, _ = ran(spark, tmp_path, batches, late="110 seconds")
    out = gate_clips(frame(spark, keys), "k", ["ts", "event"], "ts", F.col("level")).collect()
    sec = lambda x: (x - T0).total_seconds()
    assert got == sorted((r["k"], r["clip_no"], sec(r["start_ts"]), sec(r["end_ts"]), r["n_blocks"], r["closed"]) for r in long_enough(spark.createDataFrame(out), 0).collect())
    assert any(not r[-1] for r in got)


def test_a_quiet_device_ends_and_its_state_goes(spark, tmp_path):
    batches = [
        [(1, 0, 0.0, 900.0), (1, 1, 3.0, 900.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 900.0)],
        [(3, 1, 5.0, 900.0), (3, 2, 14.9, 900.0), (3, 3, 40.0, 900.0)],  # 40 seconds: device 3 is heard again after a gap
        [(3, 4, 300.0, None)],
        [(3, 5, 900.0, None)],
    ]
    got, state = ran(spark, tmp_path, batches, late="0 seconds", quiet=10.0)
    assert got == [(1, 1, 0.0, 3.0, 2, False), (3, 1, 0.0, 14.9, 3, False), (3, 1, 40.0, 40.0, 1, False)]
    assert state[-1] <= 2  # the block that is still waiting, and its timer


def test_blocks_of_one_time_come_in_the_order_of_events(spark, tmp_path):
    batches = [[(1, 10, 5.0, 0.0), (1, 9, 5.0, 900.0), (1, None, 5.0, 0.0), (1, 11, 9.0, 0.0)], [(2, 1, 100.0, None)], [(2, 1, 200.0, None)]]
    got, _ = ran(spark, tmp_path, batches, late="1 second")
    assert got == [(1, 1, 5.0, 9.0, 3, True)]


def test_state_comes_with_the_blocks(spark, tmp_path):
    """No call to a state server for each device."""
    (tmp_path / "in").mkdir()
    out = ordered_gate_stream(block_stream(spark, str(tmp_path / "in"), SCHEMA), "k", "ts", "event", "level")
    plan = out._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
