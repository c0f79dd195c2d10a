"""The control fold: single steps by hand, and the streaming job against the batch fold."""

import pytest

from blockflow.operators import control as C

CALM = {"rtt_ms": 20.0, "jitter_ms": 1.0, "loss": 0.0, "queue_bytes": 0, "nacks": 0, "pli": False, "fir": False, "estimate_bps": 0, "decode_ms": None, "scene_change": False, "encode_ms": 5.0, "last_bytes": 0}


def run(rows, config=C.Config()):
    s = C.State(bps=config.initial_bps)
    return [C.step(s, CALM | r, config) for r in rows]


def test_thresholds_are_strict():
    assert not run([{"loss": 0.02}])[0]["congestion"] and run([{"loss": 0.0201}])[0]["congestion"]
    assert not run([{"queue_bytes": 100_000}])[0]["congestion"] and not run([{"nacks": 5}])[0]["congestion"]


def test_cut_and_floor():
    out = run([{"loss": 0.5}] * 30)
    assert out[0]["target_bps"] == 5_600_000 and out[-1]["target_bps"] == 500_000


def test_rise_once_a_window():
    out = run([{}] * 62)
    assert [r["target_bps"] for r in out[:61]] == [8_000_000] * 60 + [8_400_000]


def test_baseline_moves_before_the_comparison():
    assert C.drift(0.0, 30.0) == 30.0 and C.drift(30.0, 20.0) == 20.0 and C.drift(20.0, 276.0) == 21.0 and C.drift(20.0, 0.0) == 20.0


def test_recovery_cooldown_runs_out_exactly():
    out = run([{"pli": True}] * 62)
    assert [i for i, r in enumerate(out) if r["force_idr"]] == [0, 60]
    assert all(r["intra_refresh"] for i, r in enumerate(out) if i not in (0, 60))


def test_priority_of_requests():
    assert run([{"pli": True, "fir": True, "scene_change": True}])[0]["recovery_reason"] == "FIR_requested"
    assert run([{"pli": True, "scene_change": True}])[0]["recovery_reason"] == "PLI_detected"


def test_cascade_down_and_up():
    c = C.Config(adaptation_cooldown=0)
    down = run([{"loss": 0.2}] * 9, c)
    assert [(r["speed"], r["fps"], r["width"]) for r in down][-1] == (3, 15, 640)
    s = C.State(bps=c.initial_bps, speed=3, fps=15, rung=1)
    up = [C.step(s, CALM, c)["adaptation_reason"] for _ in range(3)]
    assert up == ["resolution_increase_stable", "fps_increase_stable", "fps_increase_stable"]


@pytest.mark.parametrize(("bps", "qp"), [(8_000_000, 28), (4_000_000, 34), (5_000_000, 31), (6_600_000, 29), (500_000, 51)])
def test_qp_of_a_bitrate(bps, qp):
    assert C.qp_for(bps, 0.0, C.Config()) == min(51, qp)


def test_streaming_equals_batch(spark, tmp_path):
    names = ["stream_id", "seq", *C.INPUTS]
    schema = "stream_id long, seq int, rtt_ms double, jitter_ms double, loss double, queue_bytes int, nacks int, pli boolean, fir boolean, estimate_bps int, decode_ms double, scene_change boolean, encode_ms double, last_bytes int"
    data = [tuple((CALM | {"stream_id": i % 3, "seq": i // 3, "loss": (i * 7 % 50) / 1000, "pli": i % 11 == 0})[n] for n in names) for i in range(90)]
    df = spark.createDataFrame(data, schema)
    src = str(tmp_path / "in")
    df.where("seq < 15").coalesce(1).write.mode("append").parquet(src)
    df.where("seq >= 15").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(src)
    q = C.stream_decisions(stream, C.SMALL).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.stream_id, r.seq)
    assert sorted(spark.table("decided").collect(), key=key) == sorted(C.decisions(df, C.SMALL).collect(), key=key)


def test_folds_carry_one_state_across_batches(spark):
    names = ["stream_id", "seq", *C.INPUTS]
    schema = "stream_id long, seq int, rtt_ms double, jitter_ms double, loss double, queue_bytes int, nacks int, pli boolean, fir boolean, estimate_bps int, decode_ms double, scene_change boolean, encode_ms double, last_bytes int"
    data = [tuple((CALM | {"stream_id": i % 4 if i % 4 else None, "seq": i // 4, "loss": (i * 7 % 50) / 1000, "encode_ms": float(i % 23), "last_bytes": i * 997 % 90_000, "fir": i % 29 == 0})[n] for n in names) for i in range(400)]
    want = {}
    for k in (None, 1, 2, 3):
        rows = sorted((dict(zip(names, r)) for r in data if r[0] == k), key=lambda r: r["seq"])
        want[k] = run(rows, C.SMALL)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # streams cross batches
    try:
        got = C.decisions(spark.createDataFrame(data, schema).repartition(5), C.SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 400
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k not in ("stream_id", "seq")} == {k: want[r.stream_id][r.seq][k] for k in want[r.stream_id][r.seq]}
    assert max(r.overshoots for r in got) > 3 and {r.speed for r in got} >= {1, 2, 3}


def test_rows_behind_the_last_one_are_ignored(spark, tmp_path):
    names = ["stream_id", "seq", *C.INPUTS]
    schema = "stream_id long, seq int, rtt_ms double, jitter_ms double, loss double, queue_bytes int, nacks int, pli boolean, fir boolean, estimate_bps int, decode_ms double, scene_change boolean, encode_ms double, last_bytes int"
    data = [tuple((CALM | {"stream_id": 1, "seq": q})[n] for n in names) for q in (0, 1, 2, 5, 3, 4, 6)]
    src = str(tmp_path / "in")
    for k, part in enumerate((data[:4], data[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = C.stream_decisions(spark.readStream.schema(schema).parquet(src), C.SMALL).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 5, 6]


def test_newest_feedback_of_each_interval(spark, tmp_path):
    from datetime import datetime, timedelta

    from blockflow.streaming import newest_feedback

    t0 = datetime(2024, 1, 1)
    data = [(i % 2, i, float(i), t0 + timedelta(milliseconds=250 * i)) for i in range(40)]
    schema = "stream_id long, seq int, rtt_ms double, ts timestamp"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = newest_feedback(stream).writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.stream_id, r.seq): r.dropped for r in spark.table("newest").collect()}
    assert got == {(s, 4 * k + 2 + s): 1 for s in (0, 1) for k in range(10)}


def test_late_feedback_is_dropped_behind_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    from blockflow.streaming import newest_feedback

    t0, schema = datetime(2024, 1, 1), "stream_id long, seq int, rtt_ms double, ts timestamp"
    parts = [[(1, 0, 1.0, t0), (1, 1, 1.0, t0 + timedelta(seconds=60))], [(1, 2, 9.0, t0 + timedelta(milliseconds=500)), (1, 3, 1.0, t0 + timedelta(seconds=120))], [(1, 4, 1.0, t0 + timedelta(seconds=200))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = newest_feedback(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.start, r.seq, r.dropped) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (t0, 0, 0) in got and all(seq != 2 for _, seq, _ in got)
