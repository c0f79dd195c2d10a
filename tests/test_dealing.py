"""How rows of planes and frames are spread: no table of samples is joined, and frames of few bytes do not end in one task."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockflow.operators import motion as M
from blockflow.plans import catalog
from blockflow.sources import adapters as A

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def tasks(rows):
    return len({r.task for r in rows.select(F.spark_partition_id().alias("task")).distinct().collect()})


@pytest.mark.parametrize("name", ["q_chroma_interp", "q_halo", "q_pad_extend"])
def test_samples_are_not_joined(spark, name):
    rows = catalog.QUERIES[name](spark, DATA)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert tasks(rows) > 4


def test_every_frame_comes_once(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.expr("vec_id div 24")).distinct().count()
    assert [r.f for r in A.frame_numbers(spark, DATA).orderBy("f").collect()] == list(range(n))


def test_streams_of_feedback_are_dealt(spark):
    assert tasks(A.feedback(spark, DATA)) > 4
    assert tasks(catalog.QUERIES["q_session"](spark, DATA)) > 4


def test_a_generated_macroblock_is_encoded_once():
    from blockflow.operators import session as Q

    Q._frame_bytes.cache_clear()
    sizes = [[Q._frame_bytes(k, qp, k % 2) for k in range(6) for qp in (20, 40)] for _ in range(3)]
    assert sizes[0] == sizes[1] == sizes[2] == [Q._frame_bytes.__wrapped__(k, qp, k % 2) for k in range(6) for qp in (20, 40)]
    assert Q._frame_bytes.cache_info().misses == 12 and len(set(sizes[0])) > 1


#: Queries whose rows are frames (by_frame).
BY_FRAME = ["q_motion_rings", "q_inter_recon", "q_motion_search", "q_intra4_frame"]


@pytest.mark.parametrize("name", BY_FRAME)
def test_frames_are_dealt(spark, name):
    assert tasks(catalog.QUERIES[name](spark, DATA)) > 4


def test_groups_of_pictures_are_dealt(spark):
    """What q_encode_pictures, q_stream_files and q_movie_files encode: two streams of two groups here, which were one task's."""
    from blockflow.operators import session as Q

    rows = Q.encode_groups(Q._scenes(spark, DATA)).select("stream_id", F.expr("frame_idx div 12").alias("group"), F.spark_partition_id().alias("task")).distinct().collect()
    assert len(rows) == len({(r.stream_id, r.group) for r in rows}) and len({r.task for r in rows}) > 1


def test_intra_estimates_rest_on_dealt_frames(spark):
    """Their kernel runs in as many tasks as the query says, not in one."""
    rows = catalog.QUERIES["q_intra4_estimate"](spark, DATA)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "REPARTITION_BY_NUM" in plan


def test_a_plane_is_made_once_for_both_frames_that_read_it(spark):
    """It was made twice, for the frame and for the one behind it, and the two were joined."""
    rows = M.pairs(spark, DATA)
    planes = {r.frame_idx: bytes(r.px) for r in A.frames(spark, DATA).collect()}
    got = {r.frame_idx: (bytes(r.cur), bytes(r.ref), r.width, r.height) for r in rows.collect()}
    assert got == {f: (px, planes[f - 1], A.PLANE_WIDTH, A.PLANE_HEIGHT) for f, px in planes.items() if f - 1 in planes}
    assert rows.count() == len(got)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 1 and "Join" not in plan


@pytest.mark.parametrize("missing", [[], [3], [0, 4, 5]])
def test_frames_without_the_one_before_have_no_pair(spark, monkeypatch, missing):
    numbers = [f for f in range(8) if f not in missing]
    monkeypatch.setattr(A, "frame_numbers", lambda spark, d: spark.createDataFrame([(f,) for f in numbers], "f long"))
    assert sorted(r.frame_idx for r in M.pairs(spark, None).collect()) == [f for f in numbers if f - 1 in numbers]


def test_rows_of_many_frames_go_back_together(monkeypatch):
    """Every frame's rows, six of a search, were a batch of their own."""
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(M, "dealt", lambda rows, *_: rows)
    plane = np.arange(12, dtype=np.uint8).reshape(3, 4)
    run = M.by_frame(Rows(), lambda f, px: [(f, int(px[2, 3]) + k) for k in range(f % 7)], ["frame_idx", "px"], "frame_idx long, v int")
    batch = lambda fs: pa.RecordBatch.from_pydict({"width": [4] * len(fs), "height": [3] * len(fs), "frame_idx": fs, "px": [plane.tobytes()] * len(fs)})
    made = list(run(iter([batch(list(range(900))), batch(list(range(900, 2000))), batch([])])))
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == [(f, 11 + k) for f in range(2000) for k in range(f % 7)]
    assert len(made) == 2 and all(b.num_rows < M.ROWS + 7 for b in made)
    monkeypatch.setattr(M, "SAMPLES", 12)  # a frame of that many samples, whose rows may hold all of them, goes back by itself
    assert [b.num_rows for b in run(iter([batch([1, 2, 7, 3])]))] == [1, 2, 3]
    assert not list(run(iter([batch([0, 7])])))
