"""Boxes read back by a parser of their own; budgets and refinements by loops."""

import itertools
import os
import random

import numpy as np
import pytest

from blockflow.functions import vlc as V
from blockflow.operators import bits as S
from blockflow.operators import container as C
from blockflow.operators import entropy as E
from blockflow.operators import rate as R
from blockflow.sources import adapters as A

DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def boxes(b, at=0, end=None):
    """(kind, contents) of neighbouring boxes."""
    end = len(b) if end is None else end
    while at < end:
        size = int.from_bytes(b[at : at + 4], "big")
        assert size >= 8 and at + size <= end
        yield b[at + 4 : at + 8].decode(), b[at + 8 : at + size]
        at += size


@data
def test_movie_boxes_are_read_back(spark):
    samples = {}
    for r in A.feedback(spark, DATA).collect():
        samples.setdefault(r.stream_id, []).append((r.seq, r.last_bytes + 5))
    ticks, sync = {}, {}
    for r in S.mp4_durations(spark, DATA).collect():
        ticks[r.stream_id] = ticks.get(r.stream_id, 0) + r.duration
    for r in S.sync_samples(spark, DATA).collect():
        sync.setdefault(r.stream_id, []).append(r.sample_number)
    rows = C.mp4_movie(spark, DATA).collect()
    assert len(rows) == len(samples)
    for r in rows:
        (kind, brand), = boxes(bytes.fromhex(r.ftyp))
        assert kind == "ftyp" and brand[:4] == b"mp42"
        (_, moov), = boxes(bytes.fromhex(r.moov))
        top = dict(boxes(moov))
        trak = dict(boxes(top["trak"]))
        mdia = dict(boxes(trak["mdia"]))
        stbl = dict(boxes(dict(boxes(mdia["minf"]))["stbl"]))
        u = lambda b, k: int.from_bytes(b[4 * k : 4 * k + 4], "big")
        assert u(mdia["mdhd"], 3) == 90_000 and u(mdia["mdhd"], 4) == ticks[r.stream_id] and u(top["mvhd"], 4) == ticks[r.stream_id] * 1_000 // 90_000
        assert len(top["mvhd"]) == 100 and len(trak["tkhd"]) == 84
        n = u(stbl["stsz"], 2)
        assert [u(stbl["stsz"], 3 + k) for k in range(n)] == [s for _, s in sorted(samples[r.stream_id])]
        assert [u(stbl["stss"], 2 + k) for k in range(u(stbl["stss"], 1))] == sorted(sync[r.stream_id])
        assert u(stbl["stsc"], 3) == n and sum(u(stbl["stts"], 2 + 2 * k) for k in range(u(stbl["stts"], 1))) == n and u(stbl["stco"], 2) == 36
        (kind, entry), = boxes(stbl["stsd"], 8)
        (_, avcc), = boxes(entry, 78)
        size = int.from_bytes(avcc[6:8], "big")
        assert kind == "avc1" and avcc[8] & 31 == 7 and avcc[8 + size + 3] & 31 == 8 and avcc[1:4] == avcc[9:12]


def test_half_even_and_budget():
    assert [R.half_even(n, 2) for n in (-5, -3, -1, 1, 3, 5, 4)] == [-2, -2, 0, 0, 2, 2, 2]
    b = R.Budget(600, 6, 28)
    qps = []
    for _ in range(6):
        qps.append(b.next_qp(0))
        b.update(5_000)
    assert qps[0] == 28 and qps == sorted(qps) and all(j - i <= 25 for i, j in zip(qps, qps[1:])) and qps[-1] == 51
    assert R.Budget(0, 6, 31).next_qp(9_999) == 31


def test_slices_of_equal_effort():
    assert R.cut_rows([100] * 12, [0, 4, 8, 12], 1) == [0, 4, 8, 12]
    heavy = R.cut_rows([1_000] * 3 + [10] * 9, [0, 4, 8, 12], 1)
    assert heavy[0] == 0 and heavy[-1] == 12 and heavy == sorted(set(heavy)) and heavy[1] < 4
    r = random.Random(1)
    for _ in range(200):
        rows = R.cut_rows([r.randint(0, 5_000) for _ in range(12)], [0, r.randint(1, 4), r.randint(5, 11), 12], 1)
        assert rows[0] == 0 and rows[-1] == 12 and all(a < b for a, b in zip(rows, rows[1:]))


def test_length_of_chroma_dc_codes(spark):
    r = random.Random(5)
    levels = [tuple(r.choice([0, 0, 1, -1, 2, -7, 15, -16, 40, 1500]) for _ in range(4)) for _ in range(300)] + [(0, 0, 0, 0)]
    df = spark.createDataFrame([(k, list(v)) for k, v in enumerate(levels)], "id int, z array<int>")
    for row in E.residual(df, "z", "", dc=True).collect():
        assert len(row.bits) == R.dc_bits(levels[row.id]), levels[row.id]


def test_refinement_never_costs_more():
    r = np.random.default_rng(4)
    for _ in range(60):
        dc, scale, lam = r.integers(-4_000, 4_000, 4), int(r.integers(160, 5_000)), float(r.uniform(0.05, 400))
        first = tuple(int(v) for v in np.rint(R._H2 @ dc * 64 / scale).clip(-2048, 2048))
        levels, cost = R.dc_refined(dc, scale, first, lam)
        assert cost == R.dc_cost(dc, scale, levels, lam) <= R.dc_cost(dc, scale, first, lam)


def test_prefix_tables_are_complete_enough():
    assert all(len(line) == min(t, 3) + 1 for table in V.TOKENS for t, line in enumerate(table))
    assert [len(x) for x in V.TOTAL_ZEROS] == list(range(16, 1, -1)) and [len(x) for x in V.RUNS] == [2, 3, 4, 5, 6, 7, 15]
    assert all(sum(2.0 ** -len(c) for c in line) <= 1 for line in itertools.chain(V.TOTAL_ZEROS, V.RUNS))
