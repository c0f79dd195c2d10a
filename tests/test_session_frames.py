"""Sessions on frames: the fold against a loop, the stream against the fold after a restart, slices against the decoder."""

from __future__ import annotations

import os
from dataclasses import replace

import numpy as np
import pytest

from blockflow.operators import control as C
from blockflow.operators import session as Q
from blockflow.streaming import session as S
from tests.test_inter import Decoder, scene, split_units

DATA = "/root/testdata/sf0.001"
CALM = {"rtt_ms": 20.0, "jitter_ms": 1.0, "loss": 0.0, "queue_bytes": 0, "nacks": 0, "pli": False, "fir": False, "estimate_bps": 0, "decode_ms": None, "scene_change": False, "encode_ms": 2.0}
BAD = CALM | {"loss": 0.2, "queue_bytes": 400_000, "nacks": 9}
CONFIG = replace(C.SMALL, adaptation_cooldown=1, idr_cooldown=3)


def feedback(k):
    return BAD if 3 <= k < 21 else CALM | {"fir": k == 25, "pli": k == 26}


def planes(k):
    return tuple(p.astype(np.uint8) for p in scene(k, 48, 32, 9))


def looped(n, **how):
    s = S.Session(CONFIG, **how)
    return [s.step(feedback(k), planes(k)) for k in range(n)]


def named(rows):
    return [dict(zip(S._NAMES, r)) for r in rows]


def test_frames_have_the_decided_size_and_intra_pictures():
    rows = named(looped(40))
    assert {(r["width"], r["height"]) for r in rows} == set(S.SIZES) and rows[0]["idr"]
    for a, b in zip(rows, rows[1:]):
        changed = (a["width"], a["height"]) != (b["width"], b["height"])
        assert changed == b["recommended"] and (not changed or b["idr"])
        assert b["frame_num"] == (0 if b["idr"] else (a["frame_num"] + 1) % 16)
    assert rows[25]["idr"] and rows[26]["intra_refresh"] and not rows[26]["idr"]
    assert len({r["qp"] for r in rows}) > 2 and {r["speed"] for r in rows} >= {1, 2, 3}


def test_what_is_recommended_need_not_be_applied():
    rows = named(looped(30, resize=lambda decision, rung: rung < 2))
    sizes = [S.SIZES.index((r["width"], r["height"])) for r in rows]
    assert max(sizes) == 2 and sum(r["recommended"] for r in rows) > 2  # told again and again, as the controller knows what is in force
    never = named(looped(30, resize=lambda decision, rung: False))
    assert {(r["width"], r["height"]) for r in never} == {S.SIZES[0]} and sum(r["recommended"] for r in never) > 2


def test_recovery_is_an_argument():
    often = lambda state, f, config: {"force_idr": True, "intra_refresh": False, "recovery_reason": "own", "idr_count": 0, "pli_count": 0, "fir_count": 0}
    assert all(r["idr"] and r["frame_num"] == 0 for r in named(looped(6, recovery=often)))


def test_units_decode():
    s, decoder = S.Session(CONFIG), None
    for k in range(14):
        before, group = s.rung, s.group
        units = []
        add = group.add
        group.add = lambda *a, **b: units.append(add(*a, **b)) or units[-1]  # noqa: B023
        row = dict(zip(S._NAMES, s.step(feedback(k), planes(k))))
        group.add = add
        if decoder is None or before != s.rung:
            decoder = Decoder(row["width"], row["height"])
        assert all(np.array_equal(a, b) for a, b in zip(decoder.picture(split_units(units[0][0]), row["qp"]), units[0][2]))


def test_state_is_all_that_a_session_is():
    one, rows = S.Session(CONFIG), []
    for k in range(30):
        rows.append(one.step(feedback(k), planes(k)))
        one = S.Session(CONFIG).restore(*one.saved())
    assert rows == looped(30)


def table(spark, streams, n, first=0):
    kind = "stream_id long, seq long, rtt_ms double, jitter_ms double, loss double, queue_bytes int, nacks int, pli boolean, fir boolean, estimate_bps int, decode_ms double, scene_change boolean, encode_ms double, src_width int, src_height int, y binary, u binary, v binary"
    return spark.createDataFrame([(i, k, *(feedback(k + i)[x] for x in S.INPUTS), 48, 32, *(bytearray(p.tobytes()) for p in planes(k))) for i in streams for k in range(first, n)], kind)


def test_stream_equals_fold_after_a_restart(spark, tmp_path):
    whole = table(spark, (0, 1, 2), 18)
    want = sorted(tuple(r) for r in S.encoded(whole.repartition(4), lambda: S.Session(CONFIG)).collect())
    assert [w[2:] for w in want if w[0] == 0] == looped(18)
    source = str(tmp_path / "in")
    for part, (a, b) in enumerate(((0, 7), (7, 12), (11, 18))):  # a row comes twice: the second is ignored
        table(spark, (0, 1, 2), b, a).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(whole.schema).parquet(source)
        query = S.stream_encoded(rows, lambda: S.Session(CONFIG)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        query.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_query_over_the_tables(spark):
    rows = Q.session_frames(spark, DATA).collect()
    assert len(rows) == Q.session_input(spark, DATA).count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    streams = {}
    for r in rows:
        streams.setdefault(r.stream_id, []).append(r)
    given = {}
    for r in Q.session_input(spark, DATA).collect():
        given.setdefault(r.stream_id, []).append(r)
    i = min(streams)
    s, got = S.Session(C.SMALL), sorted(streams[i], key=lambda r: r.seq)
    for a, b in zip(sorted(given[i], key=lambda r: r.seq), got):
        assert s.step({n: a[n] for n in S.INPUTS}, S._source(a.src_width, a.src_height, bytes(a.y), bytes(a.u), bytes(a.v))) == tuple(b)[2:]



def test_small_streams_are_dealt_to_several_tasks(spark):
    from pyspark.sql import functions as F

    rows = Q.session_input(spark, DATA).where("seq < 2")
    out = S.encoded(rows, lambda: S.Session(C.SMALL)).select("stream_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in out}) > 4  # the session's shuffle partitions, which Spark joins to one
    assert len(out) == len({r.stream_id for r in out})


def test_a_stream_in_the_state_of_another_takes_its_picture(monkeypatch):
    from blockflow.functions import inter

    S._KEPT.clear()
    monkeypatch.setattr(S, "KEPT", 30)
    calls, add = [], inter.Group.add
    monkeypatch.setattr(inter.Group, "add", lambda self, *a, **k: calls.append(1) or add(self, *a, **k))
    first, n = looped(27, share=True), len(calls)
    assert first == looped(27) and len(calls) == 2 * n
    assert looped(27, share=True) == first and len(calls) == 2 * n and len(S._KEPT) <= 30
    # Another QP, or another picture before, is another state.
    s = S.Session(CONFIG, share=True)
    s.step(feedback(0), planes(5))
    s.step(feedback(1), planes(1))
    assert len(calls) == 2 * n + 2


def once(spark, rows, path, partitions=3):
    """What encoded_once makes of a table of feedback and frames, whose pictures go by seq."""
    from pyspark.sql import functions as F

    pictures = rows.select(F.col("seq").alias("picture"), *S.FRAME).dropDuplicates(["picture"])
    given = rows.select("stream_id", "seq", *S.INPUTS, F.col("seq").alias("picture")).repartition(partitions, "stream_id").sortWithinPartitions("stream_id", "seq")
    return S.encoded_once(given, pictures, lambda: S.Session(CONFIG), str(path))


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_pictures_encoded_once_are_those_of_each_stream_by_itself(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "TOLD", 4)  # forgotten again and again: told twice, encoded once
    rows = table(spark, (1, 9), 30)
    nameless = rows.where("stream_id = 1").withColumn("stream_id", F.lit(None).cast("long"))
    got = once(spark, rows.union(nameless), tmp_path / "a").collect()
    want = S.encoded(rows.union(nameless), lambda: S.Session(CONFIG)).collect()
    assert by_key(got) == by_key(want) and len(got) == 90 and list(got[0].asDict()) == ["stream_id", "seq", *S._NAMES]
    assert once(spark, rows.limit(0), tmp_path / "b").collect() == []


def test_a_picture_of_many_streams_is_encoded_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    seen, inner = [], S._encoded_nodes
    monkeypatch.setattr(S, "_encoded_nodes", lambda places, qp: seen.append(places) or inner(places, qp))
    one = table(spark, (0,), 24)
    many = one.withColumn("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))  # streams of six tasks
    got = once(spark, many, tmp_path / "a", 6)
    encoded = [r for p in seen for r in p.select(F.explode("nodes").alias("n")).select("n.*").where("NOT helper").collect()]
    assert len(encoded) == len({r.node for r in encoded}) == 24
    assert by_key(got.collect()) == [(i, k, *r) for i in range(12) for k, r in enumerate(looped(24))]


def test_policies_that_may_read_what_was_encoded_are_no_shared_ones(spark, tmp_path):
    with pytest.raises(ValueError, match="policy"):
        S.encoded_once(table(spark, (0,), 2), None, lambda: S.Session(CONFIG, resize=lambda decision, rung: False), str(tmp_path / "a"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_query_equals_the_fold_of_every_stream(spark):
    want = S.encoded(Q.session_input(spark, DATA), lambda: S.Session(C.SMALL)).collect()
    assert by_key(Q.session_frames(spark, DATA).collect()) == by_key(want)


def test_groups_that_go_on_from_one_picture_share_what_does_not_depend_on_settings():
    from blockflow.functions import inter, motion
    from blockflow.operators.motion import tables

    def after(known, qp, **search):
        g = inter.Group(30, 1, tables())
        g.add(tuple(p.astype(np.int64) for p in planes(0)))
        g.known = known
        unit, _, rec = g.add(tuple(p.astype(np.int64) for p in planes(1)), qp, **search)
        return unit, [p.tolist() for p in rec]

    known = {}
    for how in ((24, {}), (40, {}), (33, {"satd": False}), (33, {"satd": False, "sub": False}), (24, {})):
        assert after(known, how[0], **how[1]) == after(None, how[0], **how[1])
    assert len([k for k in known if isinstance(k, tuple)]) == 12  # six macroblocks, two ways to rank
    own, ref = planes(1)[0].astype(np.int64)[:16, :16], motion.padded(planes(0)[0])
    costs = motion.Block(own, ref, motion.HALO, motion.HALO, 8, False).of("q10")
    plain = lambda dx, dy: int(np.abs(own[:8, 8:] - ref[24 + dy : 32 + dy, 32 + dx : 40 + dx]).sum())
    assert [[int(costs[dy + 8, dx + 8]) for dx in range(-8, 9)] for dy in range(-8, 9)] == [[plain(dx, dy) for dx in range(-8, 9)] for dy in range(-8, 9)]
