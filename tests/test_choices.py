"""Choices of macroblocks: every rule from the columns of a row, every number by a loop."""

from __future__ import annotations

import os

import numpy as np
import pytest

from blockflow.functions import tables as T
from blockflow.operators import choices as C
from blockflow.sources import adapters as A
from tests.test_inter import scene

DATA = "/root/testdata/sf0.001"
LAM = T.LAMBDA_SATD[28]


def checked(rows, cap, mbs):
    """The rules, row by row, written from their definition."""
    spent, tried, frame = 0, 0, None
    for r in rows:
        if r.frame_idx != frame:
            spent, tried, frame = 0, 0, r.frame_idx
        assert r.consumed == spent
        share = r.consumed / (cap * mbs)
        assert r.tier == (3 if share >= 1 else 2 if share >= 0.75 else 1 if share >= 0.5 else 0)
        tried += r.variance >= 64
        assert r.sub == (r.variance >= 64 and r.tier < 3)
        assert r.sub_cap == min({0: 16, 1: 8}.get(r.tier, 4), 4 if tried > max(8, mbs // 4) else 16)
        spent += r.effort
        base = 32 if r.variance >= 512 else 16 if r.variance >= 64 else 8
        far = max(abs(r.temporal_x), abs(r.temporal_y)) // 4 if r.temporal_x is not None else None
        assert (r.sad_temporal is not None) == (r.sad_skip > 2_048 and far is not None and (r.temporal_x, r.temporal_y) != (r.skip_x, r.skip_y))
        assert r.explained == (r.sad_temporal is not None and r.sad_temporal < r.sad_skip // 2)
        if r.explained:
            want = min(32, max(8, far + 4))
        elif r.sad_skip > 2_048:
            want = max(base, 24 if r.sad_skip <= 4_096 else 32)
        else:
            want = max(base, min(32, max(8, far + 2))) if far is not None and base == 8 else base
        assert r.range == want
        if r.probe0 is not None:
            assert r.total <= min(1_024, 32 * LAM) + 2 * LAM and r.searched1 == (r.probe1 + 2 * LAM < r.probe0)
        assert (r.total1 is not None) == r.searched1 and (r.tier < 2 or not r.searched1)
        assert r.reference == (1 if r.searched1 and r.total1 + 2 * LAM < r.total else 0)
        assert r.inter_rd == r.inter_satd + LAM * r.inter_bits
        mode_bits = 64 + 2 * int(np.floor(np.log2(19 + r.intra_mode))) + 1
        assert r.intra_rd == r.intra_satd + LAM * mode_bits
        decisive = lambda rd: rd + rd // 4 < r.inter_rd  # noqa: B023, E731
        if decisive(r.intra_rd):
            assert r.choice == "intra16" and r.intra4_rd is None
        elif r.inter_satd >= 3_000:
            assert r.intra4_rd == r.intra4_satd + LAM * (mode_bits + 16)
            assert r.choice == ("intra4" if decisive(r.intra4_rd) and r.intra4_rd < r.intra_rd else "inter")
        else:
            assert r.choice == "inter"


def measured(rows, clip):
    """Numbers of a macroblock by loops over samples."""
    for r in rows:
        own = clip[r.frame_idx][0][16 * r.row : 16 * r.row + 16, 16 * r.col : 16 * r.col + 16].astype(int)
        assert r.variance == (256 * int((own**2).sum()) - int(own.sum()) ** 2) // 65_536
        ref = clip[r.frame_idx - 1][0].astype(int)
        at = lambda y, x: ref[min(max(y, 0), ref.shape[0] - 1), min(max(x, 0), ref.shape[1] - 1)]  # noqa: B023, E731
        if r.sad_temporal is not None and r.sad_temporal < 2**31 - 1:
            dx, dy = r.temporal_x >> 2, r.temporal_y >> 2
            assert r.sad_temporal == sum(abs(own[j, i] - at(16 * r.row + j + dy, 16 * r.col + i + dx)) for j in range(16) for i in range(16))


def test_rules_and_numbers():
    tiers = set()
    for cap in (4_000, 1_200, 500, 150, 2):
        tiers |= {r.tier for r in one_clip(cap)}
    assert tiers == {0, 1, 2, 3}


def one_clip(cap):
    clip = [tuple(p.astype(np.uint8) for p in scene(f if f < 6 else 30 + f, 64, 48, 4, 2)) for f in range(8)]
    rng = np.random.default_rng(1)
    clip[4] = rng.integers(0, 256, (48, 64), np.uint8), clip[4][1], clip[4][2]
    clip[5] = np.full((48, 64), 77, np.uint8), clip[5][1], clip[5][2]
    chooser = C.Chooser(28, cap)
    rows = [c for f, planes in enumerate(clip) for c in chooser.picture(f, planes)]
    assert len(rows) == 7 * 12
    checked(rows, cap, 12)
    measured(rows, clip)
    assert {r.choice for r in rows} >= {"inter", "intra16"}
    for a, b in zip(rows, rows[12:]):
        assert b.temporal_x is not None or b.frame_idx == 1
    return rows


def test_better_second_reference_wins():
    still, other = scene(0, 32, 32, 5, 0), scene(9, 32, 32, 6, 0)
    chooser = C.Chooser(cap=10**6)
    for f, planes in enumerate((still, other)):
        chooser.picture(f, tuple(p.astype(np.uint8) for p in planes))
    rows = chooser.picture(2, tuple(p.astype(np.uint8) for p in still))
    assert all(r.reference == 1 and r.total1 == 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_queries_over_the_tables(spark):
    rows = sorted(C.choices(spark, DATA).collect(), key=lambda r: (r.frame_idx, r.row, r.col))
    clip = {p.frame_idx: tuple(np.frombuffer(bytes(x), np.uint8).reshape(s) for x, s in ((p.y, (32, 48)), (p.u, (16, 24)), (p.v, (16, 24)))) for p in A.pictures(spark, DATA).collect()}
    assert len(rows) == 6 * (len(clip) - len({f // C.SEGMENT for f in clip}))
    checked(rows, C.CAP, 6)
    measured(rows, clip)
    report = {(r.frame_idx, r.row): r for r in C.row_effort(spark, DATA).collect()}
    for (f, k), r in report.items():
        own = [x for x in rows if (x.frame_idx, x.row) == (f, k)]
        assert r.effort == sum(x.effort for x in own) and r.n_intra16 + r.n_intra4 + r.n_inter == len(own) == 3

