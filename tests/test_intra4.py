"""Intra 4x4 modes of whole frames against a loop over blocks, modes and samples."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockflow.functions import motion as K
from blockflow.operators import frames as R
from blockflow.operators import intra4 as I

DATA = "/root/testdata/sf0.001"


def by_loops(px):
    out = []
    for row4 in range(I.H // 4):
        for col4 in range(I.W // 4):
            y, x, s = 4 * row4, 4 * col4, dict.fromkeys(I.NAMES, 0)
            if row4:
                s |= {f"T{k}": int(px[y - 1, x + (k if k < 4 or I.right_above(row4, col4) else 3)]) for k in range(8)}
                s["Q"] = int(px[y - 1, x - 1]) if col4 else s["T0"]
            if col4:
                s |= {f"L{k}": int(px[y + k, x - 1]) for k in range(4)}
            near = [s[f"T{k}"] for k in range(4) if row4] + [s[f"L{k}"] for k in range(4) if col4]
            dc = (sum(near) + len(near) // 2) // len(near) if near else 128
            for m in range(9):
                if I.allowed(m, row4, col4):
                    r = px[y : y + 4, x : x + 4].astype(int)
                    for i in range(4):
                        for j in range(4):
                            taps, shift = (None, None) if m == 2 else R._taps(m, j, i)
                            r[i, j] -= dc if m == 2 else (sum(w * s[n] for n, w in taps.items()) + ((1 << shift) >> 1)) >> shift
                    satd = (int(np.abs(K._HADAMARD @ r @ K._HADAMARD.T).sum()) + 1) >> 1
                    out.append((7, row4, col4, m, int(np.abs(r).sum()), satd))
    return out


def kernel_of(query, monkeypatch):
    monkeypatch.setattr(I, "by_frame", lambda rows, kernel, *_: kernel)
    monkeypatch.setattr(I.A, "frames", lambda *_: None)
    return query(None, None)


def planes():
    r = np.random.default_rng(4)
    return [r.integers(0, 256, (I.H, I.W), dtype=np.uint8), np.where(r.integers(0, 2, (I.H, I.W)) > 0, 255, 0).astype(np.uint8), np.zeros((I.H, I.W), np.uint8)]


def test_modes_of_a_frame_by_loops(monkeypatch):
    kernel = kernel_of(I.intra4_frame, monkeypatch)
    for px in planes():
        assert kernel(7, px) == by_loops(px)


def test_blocks_of_a_frame_are_scored_together(monkeypatch):
    """Every mode of every block, 630 of them, was transformed by itself."""
    kernel, satd_atoms, calls = kernel_of(I.intra4_frame, monkeypatch), K.satd_atoms, []
    monkeypatch.setattr(K, "satd_atoms", lambda r: calls.append(r.shape) or satd_atoms(r))
    assert len(kernel(7, planes()[0])) == 630
    assert len(calls) == 1


def test_estimates_score_the_blocks_of_a_frame_together(spark, monkeypatch):
    """The least of each block by loops, summed by macroblock; the frame is transformed in one piece."""
    satd_atoms, calls, px = K.satd_atoms, [], planes()[0]
    monkeypatch.setattr(K, "satd_atoms", lambda r: calls.append(r.shape) or satd_atoms(r))
    monkeypatch.setattr(I.A, "frames", lambda *_: None)
    monkeypatch.setattr(I, "by_frame", lambda rows, kernel, names, schema: spark.createDataFrame(kernel(7, px), schema))
    got = {(r.row, r.col): (r.satd, r.exact) for r in I.intra4_estimate(spark, None).collect()}
    assert len(calls) == 1
    least = {}
    for _, row4, col4, _, sad, satd in by_loops(px):
        a, b = least.get((row4, col4), (satd, sad))
        least[row4, col4] = min(a, satd), min(b, sad)
    of = lambda row, col, k: sum(v[k] for (r, c), v in least.items() if (r // 4, c // 4) == (row, col))
    assert got == {(row, col): (of(row, col, 0), of(row, col, 1) == 0) for row in range(I.H // 16) for col in range(I.W // 16)}


def test_least_of_each_block_by_loops():
    for px in planes():
        least = {}
        for _, row4, col4, _, sad, satd in by_loops(px):
            a, b = least.get((row4, col4), (sad, satd))
            least[row4, col4] = min(a, sad), min(b, satd)
        assert list(zip(*(c.tolist() for c in I.least_modes(px, I._weights())))) == [(*at, *v) for at, v in least.items()]


def test_estimates_take_a_row_a_block(monkeypatch):
    """A row of every mode, 630 a frame, went to Spark and through a shuffle of its own."""
    class Taken(Exception):
        pass

    def taken(rows, kernel, *_):
        assert len(kernel(7, planes()[0])) == I.H // 4 * (I.W // 4)
        raise Taken

    monkeypatch.setattr(I, "by_frame", taken)
    monkeypatch.setattr(I.A, "frames", lambda *_: None)
    with pytest.raises(Taken):
        I.intra4_estimate(None, None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_estimates_are_those_of_the_modes(spark):
    b = I.intra4_frame(spark, DATA).groupBy("frame_idx", "row4", "col4").agg(F.min("satd").alias("satd"), F.min("sad").alias("sad"))
    want = b.groupBy("frame_idx", F.expr("row4 div 4").alias("row"), F.expr("col4 div 4").alias("col")).agg(F.sum("satd"), F.sum("sad") == 0)
    got = I.intra4_estimate(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema.simpleString() == "struct<frame_idx:bigint,row:int,col:int,satd:bigint,exact:boolean>"
