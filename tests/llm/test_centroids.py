"""op13: Exponion search against rounds over all centroids, in exact integers."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pytest

from blockflow.llm import centroids as C

KIND = "vec_id long, embedding array<float>, label int, cluster string, v int"


def by_definition(rows, k, rounds, dims):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == dims and all(y is not None and math.isfinite(y) for y in x):
            kept.append((vec_id, [max(-(2**63), min(2**63 - 1, math.floor(256 * float(np.float32(y))))) for y in x]))
    first = sorted(kept, key=lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        at = [nearest(v)[0] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, a, d in found if a == j) for j in range(len(centres))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = 2**63 - 1
    return [(i, a, min(d, top), min(inertia[a], top), min(sum(inertia), top), digest[a]) for i, a, d in found]


def got(spark, rows, k, rounds=5, dims=4):
    found, centres = C.clusters(spark.createDataFrame(rows, KIND), k, rounds, dims)
    return [tuple(r) for r in C.with_inertia(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], found


def same(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def vectors(n, dims, seed, spread=1.0, centres=0):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(centres, dims)) * 4 if centres else None
    return [(i, ((mid[i % centres] if centres else 0) + r.normal(size=dims) * spread).astype(np.float32).tolist(), 0, "c", 1) for i in range(n)]


@pytest.mark.parametrize("k,centres,spread", [(7, 0, 1.0), (12, 12, 0.1), (1, 3, 0.5), (2, 2, 0.2)])
def test_against_all_centroids(spark, k, centres, spread):
    rows = vectors(300, 4, k, spread, centres)
    same(got(spark, rows, k)[0], by_definition(rows, k, 5, 4))


def test_most_distances_are_never_computed(spark):
    rows = vectors(2_000, 4, 5, 0.05, 30)
    now, found = got(spark, rows, 30)
    same(now, by_definition(rows, 30, 5, 4))
    assert found.selectExpr("sum(scanned)").first()[0] < 2_000 * 30 * 2  # six rounds over all would be 2,000 * 30 * 6


def test_ties_repeats_and_equal_centroids(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3), 0.0, -0.5], 0, "c", 1) for i in range(27)]
    rows = grid + grid + [(5, [9.0, 9.0, 9.0, 9.0], 0, None, None), (5, [-9.0, 9.0, 9.0, 9.0], 0, None, None)]
    for k in (3, 8, 40, 100):
        same(got(spark, rows, k)[0], by_definition(rows, k, 5, 4))


def test_which_vectors_count(spark):
    inf, nan = float("inf"), float("nan")
    rows = vectors(20, 4, 1) + [(50, None, 0, "", 0), (51, [], 0, "", 0), (52, [1.0] * 3, 0, "", 0), (53, [1.0] * 5, 0, "", 0), (54, [1.0, None, 1.0, 1.0], 0, "", 0)]
    rows += [(55, [inf, 0.0, 0.0, 0.0], 0, "", 0), (56, [0.0, -inf, 0.0, 0.0], 0, "", 0), (57, [nan, 0.0, 0.0, 0.0], 0, "", 0), (None, [0.5, -0.001, 0.0, -0.0], None, None, None)]
    now, _ = got(spark, rows, 6)
    same(now, by_definition(rows, 6, 5, 4))
    assert len(now) == 21


def test_components_beyond_doubles_and_longs(spark):
    far = [(90 + j, [s * 10.0**e, 1.0, 2.0, 3.0], 0, "", 0) for j, (s, e) in enumerate([(1, 6), (-1, 9), (1, 17), (-1, 30), (1, 38)])]
    rows = vectors(30, 4, 3) + far
    same(got(spark, rows, 6)[0], by_definition(rows, 6, 5, 4))


def test_empty_table(spark):
    assert got(spark, [], 3)[0] == []
    assert got(spark, [(1, None, 0, "", 0)], 3)[0] == []


def test_bounds_hold_in_every_round():
    r = np.random.default_rng(2)
    x = r.integers(-500, 500, (400, 8)).astype(float)
    before, now = None, x[:16].copy()
    a, upper, lower = np.full(400, -1), np.zeros(400), np.zeros(400)
    for _ in range(8):
        a, upper, lower, _ = C.Geometry(now, before).step(x, a, upper, lower)
        d = np.sqrt(((x[:, None] - now[None]) ** 2).sum(axis=2))
        assert (a == d.argmin(axis=1)).all()
        own = d[np.arange(400), a]
        d[np.arange(400), a] = np.inf
        assert (upper >= own).all() and (lower <= d.min(axis=1)).all()
        before, now = now, np.array([np.floor(x[a == j].mean(axis=0)) if (a == j).any() else now[j] for j in range(16)])
