"""Search, interpolation and filters against loops that follow the definitions sample by sample."""

import os
import random

import numpy as np
import pytest

from blockflow.functions import motion as K
from blockflow.operators import motion as M


def plane(seed, w=48, h=32):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return ((np.sin(x / 3 + seed) + np.cos(y / 4 - seed)) * 50 + 128 + r.integers(-20, 20, (h, w))).clip(0, 255).astype(np.int32)


def sample(p, x, y, fx, fy):
    """One quarter sample by the standard's letters."""
    tap = lambda v: v[0] - 5 * v[1] + 20 * v[2] + 20 * v[3] - 5 * v[4] + v[5]
    clip = lambda v: max(0, min(255, v))
    G = lambda dx=0, dy=0: int(p[y + dy, x + dx])
    b = lambda dy=0: clip((tap([G(k, dy) for k in range(-2, 4)]) + 16) >> 5)
    h = lambda dx=0: clip((tap([G(dx, k) for k in range(-2, 4)]) + 16) >> 5)
    j = clip((tap([tap([G(k, dy) for k in range(-2, 4)]) for dy in range(-2, 4)]) + 512) >> 10)
    mean = lambda a, c: (a + c + 1) >> 1
    return {
        (0, 0): G(), (1, 0): mean(G(), b()), (2, 0): b(), (3, 0): mean(b(), G(1)), (0, 1): mean(G(), h()), (0, 2): h(), (0, 3): mean(h(), G(0, 1)), (1, 1): mean(b(), h()), (2, 1): mean(b(), j), (3, 1): mean(b(), h(1)),
        (1, 2): mean(h(), j), (2, 2): j, (3, 2): mean(j, h(1)), (1, 3): mean(h(), b(1)), (2, 3): mean(j, b(1)), (3, 3): mean(h(1), b(1)),
    }[fx, fy]


def test_quarter_samples_by_letters():
    p = K.padded(plane(1))
    q = K.quarter(p, 30, 28, 8, 4)
    assert all(q[fy, fx, i, k] == sample(p, 30 + k, 28 + i, fx, fy) for fy in range(4) for fx in range(4) for i in range(4) for k in range(8))


def block(seed, shift=(2, -3), satd=True, reach=8):
    ref = plane(seed)
    cur = np.roll(ref, (-shift[1], -shift[0]), (0, 1)) + np.random.default_rng(seed).integers(-3, 4, ref.shape)
    return K.Block(cur.clip(0, 255)[16:32, 16:32], K.padded(ref), 16 + K.HALO, 16 + K.HALO, reach, satd)


def cost_of(b, shape, dx, dy):
    x, y, w, h = K.SHAPES[shape]
    r = b.cur[y : y + h, x : x + w] - b.ref[b.y + y + dy : b.y + y + dy + h, b.x + x + dx : b.x + x + dx + w]
    if not b.satd:
        return int(np.abs(r).sum())
    total = 0
    for i in range(0, h, 4):
        for k in range(0, w, 4):
            m = r[i : i + 4, k : k + 4]
            t = np.zeros((4, 4), int)
            for u in range(4):
                for v in range(4):
                    t[u, v] = sum(K._HADAMARD[u][s] * K._HADAMARD[v][z] * m[s, z] for s in range(4) for z in range(4))
            total += (int(np.abs(t).sum()) + 1) >> 1
    return total


@pytest.mark.parametrize("satd", [True, False])
def test_full_search_by_loops(satd):
    b = block(3, satd=satd, reach=4)
    for shape in ("16x16", "bottom", "q10"):
        keys = [(cost_of(b, shape, dx, dy) + K.vector_cost(4, dx, dy), cost_of(b, shape, dx, dy), abs(4 * dx) + abs(4 * dy), 4 * dx, 4 * dy) for dy in range(-3, 4) for dx in range(-3, 4)]
        best = min(keys)
        assert b.full(shape, (0, 0), 3, 4) == (best[1], best[3:])


def test_hexagon_walks_as_told():
    for seed in range(6):
        b = block(seed, (seed - 3, 2 - seed))
        score = lambda dx, dy: (cost_of(b, "16x16", dx, dy) + K.vector_cost(4, 4 * dx, 4 * dy), cost_of(b, "16x16", dx, dy), abs(4 * dx) + abs(4 * dy), 4 * dx, 4 * dy)
        at, rounds = (0, 0), 0
        for pattern, most in ((K.HEXAGON, 99), (K.DIAMOND, 3)):
            rounds = 0
            while rounds < most:
                near = [(at[0] + x, at[1] + y) for x, y in pattern if max(abs(at[0] + x), abs(at[1] + y)) <= 8]
                best = min([at, *near], key=lambda p: score(*p))
                if best == at:
                    break
                at, rounds = best, rounds + 1
        assert b.hexagon((0, 0), 8, 4) == (cost_of(b, "16x16", *at), (4 * at[0], 4 * at[1]))


def test_refinement_finds_a_moved_quarter():
    ref = plane(9)
    p = K.padded(ref)
    cur = K.quarter(p, 16 + K.HALO + 1, 16 + K.HALO - 2, 16, 16)[1, 1]  # moved by (1.25, -1.75)
    b = K.Block(cur, p, 16 + K.HALO, 16 + K.HALO, 8)
    part, total, vectors = K.search(b, 1, 8)
    assert (part, total, vectors) == (0, 0, [(5, -7)])


def test_transformed_sums_are_exact_at_the_extremes():
    r = np.random.default_rng(12)
    for shape in ((4, 4), (3, 8, 16), (2, 5, 16, 16)):
        d = np.where(r.integers(0, 2, shape) > 0, 255, -255)
        q = d.reshape(*shape[:-2], shape[-2] // 4, 4, shape[-1] // 4, 4).swapaxes(-3, -2)
        assert np.array_equal(K.satd_atoms(d), (np.abs(K._HADAMARD @ q @ K._HADAMARD.T).sum(axis=(-1, -2)) + 1) >> 1)


@pytest.mark.parametrize("satd", [True, False])
def test_a_search_is_the_same_on_quarters_of_the_whole_reference(satd):
    for seed in range(8):
        cur, ref = plane(seed).astype(np.uint8), plane(seed + (seed % 2)).astype(np.uint8)
        each = [[K.search(b, M.LAMBDA, M.REACH, temporal=(12, 4)) for *_, b in M._blocks(cur, ref, satd, quarters)] for quarters in (True, False)]
        assert each[0] == each[1]


def kernel_of(query, monkeypatch):
    """What a query does to one frame."""
    monkeypatch.setattr(M, "by_frame", lambda rows, kernel, *_: kernel)
    monkeypatch.setattr(M, "pairs", lambda *_: None)
    return query(None, None)


@pytest.mark.parametrize("query", [M.inter_recon, M.motion_search, M.motion_search_sad])
def test_a_reference_is_interpolated_once(query, monkeypatch):
    """It was interpolated for every block that was refined, again for each shape, and again for what the shapes predict."""
    kernel, quarter, calls = kernel_of(query, monkeypatch), K.quarter, []
    monkeypatch.setattr(K, "quarter", lambda *a: calls.append(a) or quarter(*a))
    assert len(kernel(1, plane(1).astype(np.uint8), plane(2).astype(np.uint8))) == 6
    assert len(calls) == 1


def test_partitions_win_only_by_less():
    same = K.Block(plane(4)[0:16, 0:16], K.padded(plane(4)), K.HALO, K.HALO, 8)
    assert K.search(same, 4, 8) == (0, 0, [(0, 0)])
    ref, cur = plane(5), plane(5).copy()
    cur[0:16, 16:24] = np.roll(ref, 4, 1)[0:16, 16:24]
    cur[0:16, 24:32] = np.roll(ref, -4, 1)[0:16, 24:32]
    part, total, vectors = K.search(K.Block(cur[0:16, 16:32], K.padded(ref), 16 + K.HALO, K.HALO, 8), 1, 8)
    assert part in (2, 3) and total < 4 * 256


def test_prediction_by_samples():
    r = random.Random(2)
    y, u, v = plane(6), plane(7, 24, 16), plane(8, 24, 16)
    refs = K.padded(y), K.padded(u, K.HALO // 2), K.padded(v, K.HALO // 2)
    for part, shapes in enumerate(K.PARTS):
        vectors = [(r.randint(-30, 30), r.randint(-30, 30)) for _ in shapes]
        luma, cu, cv = K.predicted(refs, 16, 0, part, vectors)
        for shape, (mx, my) in zip(shapes, vectors):
            bx, by, w, h = K.SHAPES[shape]
            for i, k in ((0, 0), (h - 1, w - 1), (h // 2, 1)):
                assert luma[by + i, bx + k] == sample(refs[0], 16 + K.HALO + bx + k + (mx >> 2), K.HALO + by + i + (my >> 2), mx & 3, my & 3)
            for plane_, got in ((refs[1], cu), (refs[2], cv)):
                x0, y0, fx, fy = 8 + 12 + bx // 2 + (mx >> 3), 12 + by // 2 + (my >> 3), mx & 7, my & 7
                a = plane_[y0, x0], plane_[y0, x0 + 1], plane_[y0 + 1, x0], plane_[y0 + 1, x0 + 1]
                assert got[by // 2, bx // 2] == ((8 - fx) * (8 - fy) * a[0] + fx * (8 - fy) * a[1] + (8 - fx) * fy * a[2] + fx * fy * a[3] + 32) >> 6


def line(s, bs, a, b, t):
    """One luma line, by the rules."""
    p3, p2, p1, p0, q0, q1, q2, q3 = map(int, s)
    if not bs or abs(p0 - q0) >= a or abs(p1 - p0) >= b or abs(q1 - q0) >= b:
        return list(s)
    clip = lambda v, n: max(-n, min(n, v))
    ap, aq = abs(p2 - p0) < b, abs(q2 - q0) < b
    if bs < 4:
        d = clip(((q0 - p0) * 4 + p1 - q1 + 4) >> 3, t + ap + aq)
        n1 = p1 + clip((p2 + ((p0 + q0 + 1) >> 1) - 2 * p1) >> 1, t) if ap else p1
        m1 = q1 + clip((q2 + ((p0 + q0 + 1) >> 1) - 2 * q1) >> 1, t) if aq else q1
        return [p3, p2, n1, max(0, min(255, p0 + d)), max(0, min(255, q0 - d)), m1, q2, q3]
    small = abs(p0 - q0) < (a >> 2) + 2
    left = [(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, (p2 + p1 + p0 + q0 + 2) >> 2, (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3] if ap and small else [p2, p1, (2 * p1 + p0 + q1 + 2) >> 2]
    right = [(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3, (p0 + q0 + q1 + q2 + 2) >> 2, (2 * q3 + 3 * q2 + q1 + q0 + p0 + 4) >> 3] if aq and small else [(2 * q1 + q0 + p1 + 2) >> 2, q1, q2]
    return [p3, *left, *right, q3]


def test_picture_filter_by_lines():
    alpha, beta, clip = M.tables()
    r = np.random.default_rng(3)
    y, u = plane(11), plane(12, 24, 16)
    v, h = r.integers(0, 5, (8, 12)), r.integers(0, 5, (8, 12))
    v[:4, 4:8] = 0
    qp = r.integers(24, 45, (2, 3))
    got = K.filtered((y, u, 255 - u), v, h, qp, qp, (alpha, beta, clip))[0]
    want = y.copy()
    for my in range(2):
        for mx in range(3):
            for turn, strengths in ((False, v), (True, h)):
                view = want.T if turn else want
                for edge in range(4):
                    along, across = (my, mx) if not turn else (mx, my)
                    if edge == 0 and across == 0:
                        continue
                    q = int(qp[my, mx]) if edge else (int(qp[my, mx]) + int(qp[my - 1, mx] if turn else qp[my, mx - 1]) + 1) >> 1
                    for k in range(16):
                        at = (4 * my + k // 4, 4 * mx + edge) if not turn else (4 * my + edge, 4 * mx + k // 4)
                        bs, c = int(strengths[at]), 16 * across + 4 * edge
                        row = 16 * along + k
                        view[row, c - 4 : c + 4] = line(view[row, c - 4 : c + 4], bs, alpha[q], beta[q], clip[q][min(bs, 3) - 1] if bs else 0)
    assert np.array_equal(got, want) and not np.array_equal(got, y)


def test_rings_equal_the_search_of_all_offsets():
    r = np.random.default_rng(8)
    for n in range(12):
        ref = K.padded(r.integers(0, 40 if n % 3 else 256, (32, 48)), 30)
        x, y = int(r.integers(0, 32)) + 30, int(r.integers(0, 16)) + 30
        shift = r.integers(-9, 10, 2)
        cur = ref[y + shift[1] : y + shift[1] + 16, x + shift[0] : x + shift[0] + 16] + r.integers(-2, 3, (16, 16)) * (n % 2)
        around, lam, reach = (int(r.integers(-3, 4)), int(r.integers(-3, 4))), int(r.choice([1, 4, 40])), 11
        keys = []
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                ox, oy = dx + around[0], dy + around[1]
                s = int(np.abs(cur - ref[y + oy : y + oy + 16, x + ox : x + ox + 16]).sum())
                keys.append(K._key(s + K.vector_cost(lam, dx, dy), s, (4 * ox, 4 * oy)))
        best = min(keys)
        s, mv, scored = K.rings(cur, ref, x, y, reach, lam, around)
        assert (s, mv) == (best[1], best[3:]) and scored <= len(keys)
        assert K.rings(cur, ref, x, y, reach, lam, around, best[0]) is None
        assert K.rings(cur, ref, x, y, reach, lam, around, best[0] + 1)[:2] == (s, mv)
        if s == 0:
            assert scored < len(keys)


DATA = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@data
def test_motion_field_seeds_are_the_vectors_before(spark):
    rows = {(r.frame_idx, r.br, r.bc): r for r in M.motion_field(spark, DATA).collect()}
    frames = {r.frame_idx: r for r in M.picture_pairs(spark, DATA).collect()}
    assert len(rows) == 6 * len(frames)
    seeds = set()
    for (f, br, bc), r in rows.items():
        before = rows.get((f - 1, br, bc)) if f % M.FIELD else None
        assert (r.seed_x, r.seed_y) == (tuple(before.vectors[0]) if before else (0, 0))
        seeds.add((r.seed_x, r.seed_y))
        if f < 6:
            cur, ref = (np.frombuffer(bytes(p), np.uint8).reshape(32, 48) for p in (frames[f].cur, frames[f].ref))
            block = K.Block(cur[16 * br : 16 * br + 16, 16 * bc : 16 * bc + 16], K.padded(ref), 16 * bc + K.HALO, 16 * br + K.HALO, M.REACH)
            assert (r.part, r.total, [tuple(v) for v in r.vectors]) == (lambda p, t, v: (p, t, [tuple(x) for x in v]))(*K.search(block, M.LAMBDA, M.REACH, temporal=(r.seed_x, r.seed_y)))
    assert len(seeds) > 20


@data
def test_rings_of_whole_frames(spark):
    rows = M.motion_rings(spark, DATA).collect()
    assert all(r.scored <= 4_225 for r in rows) and sum(r.scored for r in rows) < 4_225 * len(rows) / 3
    near = {(r.frame_idx, r.br, r.bc): r for r in M.motion_full(spark, DATA).collect()}
    assert all(r.sad + K.vector_cost(M.LAMBDA, r.dx, r.dy) <= near[r.frame_idx, r.br, r.bc].score for r in rows)
