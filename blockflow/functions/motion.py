"""Numerical kernels on planes: interpolation, search over a window, reconstruction and in-place edge filtering.

All take and give integer numpy arrays; a plane is (height, width). They serve where one result feeds the next
(searches that walk, filters in place), which expressions on rows cannot say.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Samples that planes are extended by on every side.
HALO = 24
SHAPES = {"16x16": (0, 0, 16, 16), "top": (0, 0, 16, 8), "bottom": (0, 8, 16, 8), "left": (0, 0, 8, 16), "right": (8, 0, 8, 16), "q00": (0, 0, 8, 8), "q10": (8, 0, 8, 8), "q01": (0, 8, 8, 8), "q11": (8, 8, 8, 8)}
PARTS = (("16x16",), ("top", "bottom"), ("left", "right"), ("q00", "q10", "q01", "q11"))
HEXAGON = ((-4, 0), (4, 0), (0, -4), (0, 4), (-2, -3), (2, -3), (-2, 3), (2, 3))
DIAMOND = ((-1, 0), (1, 0), (0, -1), (0, 1))
FALLBACK_SATD, FALLBACK_SAD, GOOD = 16_384, 4_096, 4 * 16 * 16
_HADAMARD = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]], np.int32)
_BITS = np.rint(256 * np.log2(np.arange(128) + 1)).astype(np.int64)
# Both sides of the transform of a 4x4 block as one product with its sixteen samples. Its numbers are whole and, for residuals of samples, under 2^24, so
# single precision is exact; the absolute values of a block have an even sum.
_BOTH = np.ascontiguousarray(np.kron(_HADAMARD, _HADAMARD).T.astype(np.float32))
_HALVES = np.full(16, 0.5, np.float32)
#: Which of the 4x4 atoms of a macroblock a sample of it lies in.
_IN_ATOM = np.array([[k == y // 4 * 4 + x // 4 for k in range(16)] for y in range(16) for x in range(16)], np.float32)


def padded(plane: np.ndarray, halo: int = HALO) -> np.ndarray:
    """The plane with its edge samples repeated on all sides."""
    return np.pad(plane.astype(np.int32), halo, mode="edge")


def clipped(v: np.ndarray, low, high) -> np.ndarray:
    """As np.clip, which checks more than a block of samples takes to compute."""
    return np.minimum(np.maximum(v, low), high)


def _six(a: np.ndarray, axis: int) -> np.ndarray:
    """1, -5, 20, 20, -5, 1 along an axis; the result is 5 shorter and begins between samples 2 and 3."""
    n = a.shape[axis] - 5
    s = [a[:, k : k + n] if axis else a[k : k + n] for k in range(6)]
    return s[0] + s[5] - 5 * (s[1] + s[4]) + 20 * (s[2] + s[3])


def quarter(p: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """(4, 4, h, w): a block at (x, y) of a padded plane at each quarter position [fy][fx]."""
    g = p[y - 2 : y + h + 4, x - 2 : x + w + 4]
    clip = lambda v, r, s: clipped((v + r) >> s, 0, 255)
    across = _six(g, 1)  # between columns, on all lines
    b = clip(across, 16, 5)
    v = clip(_six(g, 0), 16, 5)  # between lines, on all columns
    j = clip(_six(across, 0), 512, 10)[:h, :w]
    full = lambda dy, dx: g[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
    right, below = lambda dy: b[2 + dy : 2 + dy + h, :w], lambda dx: v[:h, 2 + dx : 2 + dx + w]
    mean = lambda s, t: (s + t + 1) >> 1
    G, H1, H2, V1, V2 = full(0, 0), right(0), right(1), below(0), below(1)
    return np.array([
        [G, mean(G, H1), H1, mean(full(0, 1), H1)],
        [mean(G, V1), mean(H1, V1), mean(H1, j), mean(H1, V2)],
        [V1, mean(V1, j), j, mean(j, V2)],
        [mean(full(1, 0), V1), mean(V1, H2), mean(j, H2), mean(V2, H2)],
    ])


def quarters(p: np.ndarray) -> np.ndarray:
    """Every quarter position of a padded plane, once for all blocks of a picture; `quarter_of` reads blocks from it."""
    return quarter(p, 2, 2, p.shape[1] - 5, p.shape[0] - 5).astype(np.int16)


def quarter_of(q: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return q[:, :, y - 2 : y - 2 + h, x - 2 : x - 2 + w]


def chroma_block(p: np.ndarray, x: int, y: int, fx: int, fy: int, w: int, h: int) -> np.ndarray:
    """A chroma block at an eighth position of a padded plane, bilinear."""
    a, b, c, d = (p[y + dy : y + dy + h, x + dx : x + dx + w] for dy in (0, 1) for dx in (0, 1))
    return ((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * d + 32) >> 6


def _atoms(r: np.ndarray) -> np.ndarray:
    """The 4x4 parts of (..., h, w), a row of sixteen each."""
    h, w = r.shape[-2:]
    return r.reshape(*r.shape[:-2], h // 4, 4, w // 4, 4).swapaxes(-3, -2).astype(np.float32).reshape(-1, 16)


def satd_atoms(r: np.ndarray) -> np.ndarray:
    """(..., h/4, w/4): the transformed absolute sum of each 4x4 part of residuals (..., h, w), halved."""
    t = _atoms(r) @ _BOTH
    return (np.abs(t, out=t) @ _HALVES).astype(np.int64).reshape(*r.shape[:-2], r.shape[-2] // 4, r.shape[-1] // 4)


def sad_atoms(r: np.ndarray) -> np.ndarray:
    h, w = r.shape[-2:]
    return np.abs(r).reshape(*r.shape[:-2], h // 4, 4, w // 4, 4).sum(axis=(-1, -3))


def bits(delta: int) -> int:
    return int(_BITS[min(abs(delta), 127)])


def vector_cost(lam: int, dx: int, dy: int) -> int:
    return (lam * (bits(dx) + bits(dy))) >> 8


@cache
def _vector_costs(lam: int, reach: int) -> np.ndarray:
    """The cost of every vector up to reach from the expected one, [dy + reach, dx + reach]."""
    b = _BITS[np.minimum(np.abs(np.arange(-reach, reach + 1)), 127)]
    return (lam * (b[:, None] + b)) >> 8


def _key(score: int, s: int, mv: tuple[int, int]) -> tuple:
    """Order of candidates: score, plain cost, |x| + |y|, x, y."""
    return score, s, abs(mv[0]) + abs(mv[1]), *mv


#: Which of the sixteen 4x4 atoms a shape covers.
_COVERED = np.array([[x <= 4 * (k % 4) < x + w and y <= 4 * (k // 4) < y + h for k in range(16)] for x, y, w, h in SHAPES.values()], np.float32)


class Block:
    """A 16x16 block and the costs of all whole-sample offsets up to `reach` in the reference, by shape, computed at once from 4x4 atoms.

    quarters: those of the reference, where the caller has them for all blocks of a picture.
    """

    def __init__(self, cur: np.ndarray, ref: np.ndarray, x: int, y: int, reach: int, satd: bool = True, quarters: np.ndarray | None = None):
        self.cur, self.ref, self.x, self.y, self.reach, self.satd, self.quarters = cur.astype(np.int32), ref, x, y, reach, satd, quarters
        near = ref[y - reach : y + reach + 16, x - reach : x + reach + 16]
        n = 2 * reach + 1
        if satd:
            # The transform of a difference is the difference of the transforms, so each 4x4 part of the reference is transformed once.
            parts = np.lib.stride_tricks.sliding_window_view(near, (4, 4))
            t = (parts.astype(np.float32).reshape(-1, 16) @ _BOTH).reshape(*parts.shape[:2], 16)
            own = _atoms(self.cur) @ _BOTH
            atoms = np.empty((16, n * n), np.float32)
            for k in range(16):
                r = (t[4 * (k // 4) : 4 * (k // 4) + n, 4 * (k % 4) : 4 * (k % 4) + n] - own[k]).reshape(-1, 16)
                atoms[k] = np.abs(r, out=r) @ _HALVES
        else:
            # Sums of samples are whole and under 2^24 as well.
            r = np.lib.stride_tricks.sliding_window_view(near, (16, 16)).astype(np.float32).reshape(n * n, 256)
            r -= self.cur.ravel().astype(np.float32)
            atoms = (np.abs(r, out=r) @ _IN_ATOM).T
        self.costs = dict(zip(SHAPES, (_COVERED @ atoms).astype(np.int64).reshape(-1, n, n)))
        self.effort = 0  # positions scored so far

    def of(self, shape: str) -> np.ndarray:
        """Costs of a shape at all offsets [dy + reach, dx + reach]."""
        return self.costs[shape]

    def sad(self, dx: int, dy: int) -> int:
        """The absolute difference at a whole-sample offset."""
        return int(np.abs(self.cur - self.ref[self.y + dy : self.y + dy + 16, self.x + dx : self.x + dx + 16]).sum())

    def cost(self, shape: str, dx: int, dy: int) -> int:
        return int(self.of(shape)[dy + self.reach, dx + self.reach])

    def full(self, shape: str, around: tuple[int, int], reach: int, lam: int) -> tuple[int, tuple[int, int]]:
        """(plain cost, vector in quarters) of the best whole-sample offset within reach of a centre. The cost is of the offset from the centre."""
        (x0, x1), (y0, y1) = ((max(-self.reach, c - reach), min(self.reach, c + reach) + 1) for c in around)
        s = self.of(shape)[y0 + self.reach : y1 + self.reach, x0 + self.reach : x1 + self.reach]
        self.effort += s.size
        dx, dy = reach - around[0], reach - around[1]
        score = s + _vector_costs(lam, reach)[y0 + dy : y1 + dy, x0 + dx : x1 + dx]
        low = score.min()
        best = min(_key(int(low), int(s[j, i]), (4 * (x0 + i), 4 * (y0 + j))) for j, i in np.argwhere(score == low).tolist())
        return best[1], best[3:]

    def hexagon(self, around: tuple[int, int], reach: int, lam: int) -> tuple[int, tuple[int, int]]:
        """Steps of a large pattern to the best of its eight points until none is better, then at most three small ones."""
        def key(dx: int, dy: int):
            ox, oy = around[0] + dx, around[1] + dy
            if max(abs(dx), abs(dy)) > reach or max(abs(ox), abs(oy)) > self.reach:
                return None
            s = self.cost("16x16", ox, oy)
            self.effort += 1
            return _key(s + vector_cost(lam, 4 * dx, 4 * dy), s, (4 * ox, 4 * oy)), (dx, dy)

        at = key(0, 0)
        for pattern, rounds in ((HEXAGON, 10**9), (DIAMOND, 3)):
            while rounds:
                best = min([at, *(k for ox, oy in pattern if (k := key(at[1][0] + ox, at[1][1] + oy)))], key=lambda k: k[0])
                if best[1] == at[1]:
                    break
                at, rounds = best, rounds - 1
        return at[0][1], at[0][3:]

    def refined(self, shape: str, seed: tuple[int, tuple[int, int]], lam: int, rounds: int = 2) -> tuple[int, tuple[int, int]]:
        """(SAD, vector) after rounds over the sixteen quarter positions to the right of and below the best whole sample."""
        x, y, w, h = SHAPES[shape]
        own = self.cur[y : y + h, x : x + w]
        score, mv = seed
        fits = lambda ox, oy: self.x + x + ox >= 2 and self.y + y + oy >= 2 and self.x + x + ox + w + 3 <= self.ref.shape[1] and self.y + y + oy + h + 3 <= self.ref.shape[0]
        sad = before = None
        for _ in range(rounds):
            o = mv[0] >> 2, mv[1] >> 2
            if o == before or not fits(*o):
                break
            before = o
            at = self.x + x + o[0], self.y + y + o[1], w, h
            r = own - (quarter(self.ref, *at) if self.quarters is None else quarter_of(self.quarters, *at))
            self.effort += 16
            sads = np.abs(r).reshape(16, -1).sum(axis=1)
            if sad is None:
                sad = int(sads[0])  # at the whole sample
            costs = satd_atoms(r).reshape(16, -1).sum(axis=1) + _vector_costs(lam, 3)[3:, 3:].ravel() if self.satd else sads
            best = _key(score, sad, mv)
            for k in np.flatnonzero(costs <= score).tolist():
                to = 4 * o[0] + k % 4, 4 * o[1] + k // 4
                if to != mv and (key := _key(int(costs[k]), int(sads[k]), to)) < best:
                    best, score, sad, mv = key, int(costs[k]), int(sads[k]), to
        if sad is None:
            a, b = self.x + x + (mv[0] >> 2), self.y + y + (mv[1] >> 2)
            sad = int(np.abs(own - self.ref[b : b + h, a : a + w]).sum())
        return sad, mv


def rings(cur: np.ndarray, ref: np.ndarray, x: int, y: int, reach: int, lam: int, around: tuple[int, int] = (0, 0), ceiling: int | None = None) -> tuple[int, tuple[int, int], int] | None:
    """(SAD, vector in quarters, offsets scored) of the best offset within reach of a centre, ring by ring of equal |dx| + |dy|.

    A ring's vectors cost no less than that of its corner, which grows with the ring, so the search ends where that alone exceeds the best
    score; rows whose first half is beyond the best score are not summed further. Equals the search of all offsets. Where
    `ceiling` is given, only scores below it count, and None says that there is none: what is left of a budget that several shapes share.
    """
    h, w = cur.shape
    best, scored = None, 0
    for k in range(2 * reach + 1):
        bound = ceiling - 1 if best is None and ceiling is not None else best[0] if best else None
        if bound is not None and vector_cost(lam, min(k, reach), max(0, k - reach)) > bound:
            break
        ring = np.array([(dx, dy) for dx in range(-min(k, reach), min(k, reach) + 1) for dy in {k - abs(dx), abs(dx) - k} if abs(dy) <= reach])
        cost = (lam * (_BITS[np.minimum(np.abs(ring[:, 0]), 127)] + _BITS[np.minimum(np.abs(ring[:, 1]), 127)])) >> 8
        at = ring + around
        rows = (y + at[:, 1])[:, None, None] + np.arange(h)[:, None]
        near = ref[rows, (x + at[:, 0])[:, None, None] + np.arange(w)]
        s = np.abs(cur[: h // 2] - near[:, : h // 2]).sum(axis=(1, 2), dtype=np.int64)
        open_ = np.flatnonzero(s + cost <= bound) if bound is not None else np.arange(len(ring))
        s[open_] += np.abs(cur[h // 2 :] - near[open_, h // 2 :]).sum(axis=(1, 2), dtype=np.int64)
        scored += len(open_)
        for j in open_.tolist():
            score = int(s[j] + cost[j])
            if ceiling is None or score < ceiling:
                key = _key(score, int(s[j]), (4 * int(at[j, 0]), 4 * int(at[j, 1])))
                best = key if best is None or key < best else best
    return (best[1], best[3:], scored) if best else None


def search(block: Block, lam: int, reach: int, predictor: tuple[int, int] = (0, 0), temporal: tuple[int, int] | None = None, cap: int = 8, fallback: bool = True, sub: bool = True) -> tuple[int, int, list[tuple[int, int]]]:
    """(partition, total, vectors): the temporal seed, the hexagon search with its exhaustive fallback, then the smaller shapes around it."""
    found = []
    if temporal and temporal != (0, 0) and max(abs(temporal[0] >> 2), abs(temporal[1] >> 2)) <= block.reach:
        ox, oy = temporal[0] >> 2, temporal[1] >> 2
        found.append((block.sad(ox, oy), 0, [temporal]))
    centre = predictor[0] >> 2, predictor[1] >> 2
    cost, mv = block.refined("16x16", block.hexagon(centre, reach, lam), lam)
    if fallback and cost > (FALLBACK_SATD if block.satd else FALLBACK_SAD):
        again = block.refined("16x16", block.full("16x16", centre, reach, lam), lam)
        if again[0] * 2 < cost:
            cost, mv = again
    found.append((cost, 0, [mv]))
    best = min(found, key=lambda f: f[:1])  # of equal ones the first
    if cost <= GOOD or not sub:
        return best[1], best[0], best[2]
    around, near = (mv[0] >> 2, mv[1] >> 2), min(cap, max(reach // 2, min(8, reach)))
    for part, shapes in enumerate(PARTS[1:], 1):
        each = [block.refined(s, block.full(s, around, near, lam), lam) for s in shapes]
        total = sum(c for c, _ in each)
        if total < best[0]:
            best = total, part, [v for _, v in each]
    return best[1], best[0], best[2]


def predicted(refs: tuple[np.ndarray, np.ndarray, np.ndarray], x: int, y: int, part: int, vectors: list[tuple[int, int]], halo: int = HALO, quarters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma and both chroma predictions of the macroblock at (x, y) from padded planes (chroma padded by half as much), part by part.
    quarters: those of the luma plane, where the caller has them."""
    luma, u, v = np.zeros((16, 16), np.int32), np.zeros((8, 8), np.int32), np.zeros((8, 8), np.int32)
    for shape, (mx, my) in zip(PARTS[part], vectors):
        bx, by, w, h = SHAPES[shape]
        at = x + halo + bx + (mx >> 2), y + halo + by + (my >> 2), w, h
        luma[by : by + h, bx : bx + w] = (quarter(refs[0], *at) if quarters is None else quarter_of(quarters, *at))[my & 3, mx & 3]
        for plane, to in ((refs[1], u), (refs[2], v)):
            to[by // 2 : (by + h) // 2, bx // 2 : (bx + w) // 2] = chroma_block(plane, (x + bx + halo) // 2 + (mx >> 3), (y + by + halo) // 2 + (my >> 3), mx & 7, my & 7, w // 2, h // 2)
    return luma, u, v


def _luma_line(s: np.ndarray, bs: np.ndarray, alpha: np.ndarray, beta: np.ndarray, tc0: np.ndarray) -> np.ndarray:
    """Lines p3 p2 p1 p0 | q0 q1 q2 q3 (n, 8) after the luma filter."""
    p3, p2, p1, p0, q0, q1, q2, q3 = s.T
    gate = (bs > 0) & (np.abs(p0 - q0) < alpha) & (np.abs(p1 - p0) < beta) & (np.abs(q1 - q0) < beta)
    if not gate.any():
        return s
    ap, aq, flat = np.abs(p2 - p0) < beta, np.abs(q2 - q0) < beta, np.abs(p0 - q0) < (alpha >> 2) + 2
    tc = tc0 + ap + aq
    d = clipped(((q0 - p0) * 4 + p1 - q1 + 4) >> 3, -tc, tc)
    mid = (p0 + q0 + 1) >> 1
    deep = bs >= 4
    weak = strong = None
    if not deep.all():
        weak = {3: clipped(p0 + d, 0, 255), 4: clipped(q0 - d, 0, 255), 2: np.where(ap, p1 + clipped((p2 + mid - 2 * p1) >> 1, -tc0, tc0), p1), 5: np.where(aq, q1 + clipped((q2 + mid - 2 * q1) >> 1, -tc0, tc0), q1), 1: p2, 6: q2}
    if deep.any():
        sp, sq = flat & ap, flat & aq
        strong = {
            3: np.where(sp, (p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3, (2 * p1 + p0 + q1 + 2) >> 2), 2: np.where(sp, (p2 + p1 + p0 + q0 + 2) >> 2, p1), 1: np.where(sp, (2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, p2),
            4: np.where(sq, (q2 + 2 * q1 + 2 * q0 + 2 * p0 + p1 + 4) >> 3, (2 * q1 + q0 + p1 + 2) >> 2), 5: np.where(sq, (q2 + q1 + q0 + p0 + 2) >> 2, q1), 6: np.where(sq, (2 * q3 + 3 * q2 + q1 + q0 + p0 + 4) >> 3, q2),
        }
    out = s.copy()
    for k in range(1, 7):
        made = weak[k] if strong is None else strong[k] if weak is None else np.where(deep, strong[k], weak[k])
        out[:, k] = np.where(gate, made, s[:, k])
    return out


def _chroma_line(s: np.ndarray, bs: np.ndarray, alpha: np.ndarray, beta: np.ndarray, tc0: np.ndarray) -> np.ndarray:
    """Lines p1 p0 | q0 q1 (n, 4) after the chroma filter."""
    p1, p0, q0, q1 = s.T
    gate = (bs > 0) & (np.abs(p0 - q0) < alpha) & (np.abs(p1 - p0) < beta) & (np.abs(q1 - q0) < beta)
    if not gate.any():
        return s
    d = clipped(((q0 - p0) * 4 + p1 - q1 + 4) >> 3, -(tc0 + 1), tc0 + 1)
    out = s.copy()
    out[:, 1] = np.where(gate, np.where(bs < 4, clipped(p0 + d, 0, 255), (2 * p1 + p0 + q1 + 2) >> 2), p0)
    out[:, 2] = np.where(gate, np.where(bs < 4, clipped(q0 - d, 0, 255), (2 * q1 + q0 + p1 + 2) >> 2), q0)
    return out


def filtered(planes: tuple[np.ndarray, np.ndarray, np.ndarray], vertical: np.ndarray, horizontal: np.ndarray, qp: np.ndarray, chroma_qp: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A picture filtered in place: macroblocks in raster order, vertical edges before horizontal ones, later edges see earlier results.

    vertical, horizontal: (rows of 4x4, columns of 4x4) strengths of the left and upper edge of each 4x4 block; qp, chroma_qp: by macroblock;
    tables: thresholds alpha and beta by QP, clipping values by (QP, strength - 1).
    """
    y, u, v = (p.astype(np.int32).copy() for p in planes)
    alpha, beta, clip = tables
    n_rows, n_cols = qp.shape
    for my in range(n_rows):
        for mx in range(n_cols):
            for strengths, turn in ((vertical, False), (horizontal, True)):
                s = strengths[4 * my : 4 * my + 4, 4 * mx : 4 * mx + 4]
                s = s.T if turn else s  # s[line of blocks, edge]
                outer = (my if turn else mx) > 0
                if not s[:, 0 if outer else 1 :].any():
                    continue
                for edge in range(0 if outer else 1, 4):
                    for plane, size, q in ((y, 16, qp), (u, 8, chroma_qp), (v, 8, chroma_qp)):
                        if size == 8 and edge % 2:
                            continue
                        near = q[my, mx]
                        mean = (near + (q[my - 1, mx] if turn else q[my, mx - 1]) + 1) >> 1 if edge == 0 else near
                        bs = np.repeat(s[:, edge], size // 4)
                        if not bs.any():
                            continue
                        view = plane.T if turn else plane
                        r0, c0 = (mx if turn else my) * size, (my if turn else mx) * size + edge * size // 4
                        k, line = (4, _luma_line) if size == 16 else (2, _chroma_line)
                        t = clip[mean][np.maximum(np.minimum(bs, 3), 1) - 1]
                        view[r0 : r0 + size, c0 - k : c0 + k] = line(view[r0 : r0 + size, c0 - k : c0 + k].copy(), bs, alpha[mean], beta[mean], t)
    return y, u, v
