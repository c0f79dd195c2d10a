"""Inter slices decoded by a parser of their own, with vectors predicted by the text of the standard."""

from __future__ import annotations

import numpy as np
import pytest

from blockflow.functions import encode as E
from blockflow.functions import inter as I
from blockflow.functions import motion as K
from blockflow.functions import tables as T
from blockflow.functions import vlc as V
from blockflow.operators import motion as O
from tests.test_encode import read_block
from tests.test_entropy import Reader


def unescaped(unit):
    """Bits behind the header of a unit with a four-byte start code."""
    out, zeros = bytearray(), 0
    for b in unit[5:]:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return "".join(format(b, "08b") for b in out)


class Decoder:
    """Pictures of slices with one reference. Motion is kept by sample position, availability by the order of decoding."""

    def __init__(self, w, h):
        self.w, self.h, self.ref = w, h, None

    def picture(self, units, qp):
        self.rec = [np.zeros((self.h, self.w), np.int64), *(np.zeros((self.h // 2, self.w // 2), np.int64) for _ in "uv")]
        self.mv, self.n, self.slice_of, self.mode_of, self.kinds = {}, {}, {}, {}, []
        for number, unit in enumerate(units):
            assert unit[:4] == b"\0\0\0\1"
            bits = unescaped(unit)
            r = Reader(bits)
            if unit[4] == 0x65:
                self.i_slice(r, number, qp)
            else:
                self.p_slice(r, number, qp)
        self.filter(qp)
        return self.ref

    def i_slice(self, r, number, qp):
        at = r.ue()
        assert r.ue() == 7 and r.ue() == 0 and r.u(4) == 0
        r.ue()
        assert r.u(2) == 0 and r.se() == qp - 26 and r.ue() == 0 and r.se() == 0 and r.se() == 0
        while r.at < r.bits.rindex("1"):
            self.macroblock(at, number, qp, r, 5 + r.ue())
            at += 1
        assert r.u(1) == 1 and len(r.bits) - r.at < 8 and at % (self.w // 16) == 0

    # Vectors.
    def neighbour(self, y, x, number):
        """None: not available. A 4x4 block belongs to the slice of its macroblock."""
        return self.mv.get((y, x)) if self.slice_of.get((y // 4, x // 4)) == number else None

    def expected(self, y, x, w, h, index, shape, number):
        a, b, c = self.neighbour(y, x - 1, number), self.neighbour(y - 1, x, number), self.neighbour(y - 1, x + w, number)
        if c is None:
            c = self.neighbour(y - 1, x - 1, number)
        if b is None and c is None and a is not None:
            b = c = a
        a, b, c = (n or (-1, (0, 0)) for n in (a, b, c))
        if shape == "16x8" and index == 0 and b[0] == 0:
            return b[1]
        if shape == "16x8" and index == 1 and a[0] == 0:
            return a[1]
        if shape == "8x16" and index == 0 and a[0] == 0:
            return a[1]
        if shape == "8x16" and index == 1 and c[0] == 0:
            return c[1]
        hits = [n for n in (a, b, c) if n[0] == 0]
        if len(hits) == 1:
            return hits[0][1]
        return tuple(int(np.median([n[1][k] for n in (a, b, c)])) for k in (0, 1))

    def nc(self, plane, y, x, number):
        size = 4 if plane == 0 else 2
        known = lambda v, u: self.n[plane, v, u] if (plane, v, u) in self.n and self.slice_of.get((v // size, u // size)) == number else None
        a, b = known(y, x - 1), known(y - 1, x)
        return (a + b + 1) >> 1 if a is not None and b is not None else a if a is not None else b or 0

    def p_slice(self, r, number, qp):
        cols = self.w // 16
        at = r.ue()
        assert r.ue() == 5 and r.ue() == 0
        r.u(4)
        assert r.u(1) == 0 and r.u(1) == 0 and r.u(1) == 0
        assert r.se() == qp - 26 and r.ue() == 0 and r.se() == 0 and r.se() == 0
        while r.at < r.bits.rindex("1"):
            for _ in range(r.ue()):
                self.macroblock(at, number, qp, None, None)
                at += 1
            if r.at < r.bits.rindex("1"):
                self.macroblock(at, number, qp, r, r.ue())
                at += 1
        assert r.u(1) == 1 and len(r.bits) - r.at < 8 and at % cols == 0

    def macroblock(self, at, number, qp, r, kind):
        my, mx = divmod(at, self.w // 16)
        assert (my, mx) not in self.slice_of
        self.slice_of[my, mx] = number
        y4, x4, y, x = 4 * my, 4 * mx, 16 * my, 16 * mx
        for size, plane in ((4, 0), (2, 1), (2, 2)):
            for k in range(size * size):
                self.n[plane, size * my + k // size, size * mx + k % size] = 0
        if kind == 5:
            return self.intra4(my, mx, number, qp, r)
        if kind is not None and kind > 5:
            return self.intra(my, mx, number, qp, r, kind - 6)
        if kind is None:
            a, b = self.neighbour(y4, x4 - 1, number), self.neighbour(y4 - 1, x4, number)
            zero = a is None or b is None or a == (0, (0, 0)) or b == (0, (0, 0))
            vectors = [(0, 0, 4, 4, (0, 0) if zero else self.expected(y4, x4, 4, 4, 0, "16x16", number))]
        else:
            if kind == 3:
                assert [r.ue() for _ in range(4)] == [0] * 4
            parts = {0: [(0, 0, 4, 4)], 1: [(0, 0, 4, 2), (0, 2, 4, 2)], 2: [(0, 0, 2, 4), (2, 0, 2, 4)], 3: [(0, 0, 2, 2), (2, 0, 2, 2), (0, 2, 2, 2), (2, 2, 2, 2)]}[kind]
            vectors = []
            for index, (px, py, w, h) in enumerate(parts):
                e = self.expected(y4 + py, x4 + px, w, h, index, {1: "16x8", 2: "8x16"}.get(kind, "other"), number)
                mv = e[0] + r.se(), e[1] + r.se()
                vectors.append((px, py, w, h, mv))
                for dy in range(h):
                    for dx in range(w):
                        self.mv[y4 + py + dy, x4 + px + dx] = (0, mv)
        for px, py, w, h, mv in vectors:
            for dy in range(h):
                for dx in range(w):
                    self.mv[y4 + py + dy, x4 + px + dx] = (0, mv)
        self.kinds.append("skip" if kind is None else kind)
        pattern = V.CBP_INTER[r.ue()] if r else 0
        if pattern:
            assert r.se() == 0
        levels = np.zeros((4, 4, 4, 4), np.int64)
        for k in range(16):
            v, u = 2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2
            if pattern >> k // 4 & 1:
                scan = read_block(r, self.nc(0, y4 + v, x4 + u, number), 16)
                self.n[0, y4 + v, x4 + u] = int(np.count_nonzero(scan))
                block = np.zeros(16, np.int64)
                block[np.array(T.ZIGZAG)] = scan
                levels[v, u] = block.reshape(4, 4)
        luma, cu, cv = self.prediction(x, y, vectors)
        self.rec[0][y : y + 16, x : x + 16] = I.luma_rebuilt(luma, levels, qp)
        self.chroma(my, mx, number, qp, r, pattern >> 4, (cu, cv))

    def prediction(self, x, y, vectors):
        """Sample by sample from the reference, positions clamped to it."""
        ref, (h, w) = self.ref[0], self.ref[0].shape
        full = lambda py, px: int(ref[min(max(py, 0), h - 1), min(max(px, 0), w - 1)])
        tap = lambda s: s[0] - 5 * s[1] + 20 * s[2] + 20 * s[3] - 5 * s[4] + s[5]
        clip = lambda v: min(max(v, 0), 255)

        def half(py, px, vertical, horizontal):
            if horizontal and not vertical:
                return clip((tap([full(py, px + k) for k in range(-2, 4)]) + 16) >> 5)
            if vertical and not horizontal:
                return clip((tap([full(py + k, px) for k in range(-2, 4)]) + 16) >> 5)
            if vertical:
                return clip((tap([tap([full(py + j, px + k) for k in range(-2, 4)]) for j in range(-2, 4)]) + 512) >> 10)
            return full(py, px)

        def quarter(qy, qx):
            py, px, fy, fx = qy >> 2, qx >> 2, qy & 3, qx & 3
            if fx % 2 == 0 and fy % 2 == 0:
                return half(py, px, fy == 2, fx == 2)
            if fy % 2 == 0:  # between two neighbours on a line
                return (half(py, px + (fx == 3) * (fy == 0), fy == 2, False) + half(py, px, fy == 2, True) + 1) >> 1 if fy == 0 else (half(py, px + (fx == 3), True, False) + half(py, px, True, True) + 1) >> 1
            if fx % 2 == 0:
                return (half(py + (fy == 3), px, False, fx == 2) + half(py, px, True, fx == 2) + 1) >> 1
            return (half(py + (fy == 3), px, False, True) + half(py, px + (fx == 3), True, False) + 1) >> 1

        luma, sides = np.zeros((16, 16), np.int64), [np.zeros((8, 8), np.int64) for _ in "uv"]
        for bx, by, bw, bh, (mx, my) in vectors:
            for j in range(4 * by, 4 * (by + bh)):
                for i in range(4 * bx, 4 * (bx + bw)):
                    luma[j, i] = quarter(4 * (y + j) + my, 4 * (x + i) + mx)
            for j in range(2 * by, 2 * (by + bh)):
                for i in range(2 * bx, 2 * (bx + bw)):
                    qy, qx = 8 * (y // 2 + j) + my, 8 * (x // 2 + i) + mx
                    for side, plane in zip(sides, self.ref[1:]):
                        s = lambda dy, dx: int(plane[min(max((qy >> 3) + dy, 0), h // 2 - 1), min(max((qx >> 3) + dx, 0), w // 2 - 1)])  # noqa: B023, E731
                        fy, fx = qy & 7, qx & 7
                        side[j, i] = ((8 - fx) * (8 - fy) * s(0, 0) + fx * (8 - fy) * s(0, 1) + (8 - fx) * fy * s(1, 0) + fx * fy * s(1, 1) + 32) >> 6
        return luma, *sides

    def chroma(self, my, mx, number, qp, r, pattern, preds):
        dcs = [np.array(read_block(r, -1, 4)).reshape(2, 2) if pattern else np.zeros((2, 2), np.int64) for _ in "uv"]
        for plane in (1, 2):
            levels = np.zeros((2, 2, 4, 4), np.int64)
            for k in range(4 if pattern == 2 else 0):
                v, u = 2 * my + k // 2, 2 * mx + k % 2
                scan = read_block(r, self.nc(plane, v, u, number), 15)
                self.n[plane, v, u] = int(np.count_nonzero(scan))
                block = np.zeros(16, np.int64)
                block[np.array(T.ZIGZAG)[1:]] = scan
                levels[k // 2, k % 2] = block.reshape(4, 4)
            self.rec[plane][8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8] = E.chroma_rebuilt(preds[plane - 1], dcs[plane - 1], levels, T.chroma_qp(qp))

    def intra4(self, my, mx, number, qp, r):
        self.kinds.append("intra4")
        signs = [None if r.u(1) else r.u(3) for _ in range(16)]
        assert r.ue() == 0
        pattern = V.CBP_INTRA[r.ue()]
        if pattern:
            assert r.se() == 0
        done = {}
        for k in range(16):
            v, u = 2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2
            y, x = 4 * my + v, 4 * mx + u
            scan = read_block(r, self.nc(0, y, x, number), 16) if pattern >> k // 4 & 1 else [0] * 16
            self.n[0, y, x] = int(np.count_nonzero(scan))
            block = np.zeros(16, np.int64)
            block[np.array(T.ZIGZAG)] = scan
            done[k] = block.reshape(4, 4)
        for k in range(16):
            v, u = 2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2
            y, x = 4 * my + v, 4 * mx + u
            there = lambda b, a: 0 <= a < self.w // 4 and self.slice_of.get((b // 4, a // 4)) == number and ((b // 4, a // 4) != (my, mx) or (b, a) in self.mode_of)  # noqa: B023, E731
            near = [self.mode_of.get(p, 2) if there(*p) else None for p in ((y, x - 1), (y - 1, x))]
            likely = 2 if None in near else min(near)
            mode = likely if signs[k] is None else signs[k] + (signs[k] >= likely)
            self.mode_of[y, x] = mode
            self.rec[0][4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = np.clip(self.predicted4(y, x, mode, there) + E._inverse(E.dequantised(done[k], qp)), 0, 255)
        for k in range(16):
            self.mv[4 * my + k // 4, 4 * mx + k % 4] = (-1, (0, 0))
        top = self.slice_of.get((my - 1, mx)) == number
        self.chroma(my, mx, number, qp, r, pattern >> 4, [E.chroma_dc(self.rec[k], 8 * my, 8 * mx, top) for k in (1, 2)])

    def predicted4(self, y, x, mode, there):
        """The nine modes as the standard writes them: p(x, y) with -1 for the line above and the column to the left."""
        rec, up, left = self.rec[0], there(y - 1, x), there(y, x - 1)
        right = up and there(y - 1, x + 1)
        p = {}
        for k in range(8):
            if up:
                p[k, -1] = int(rec[4 * y - 1, 4 * x + k]) if k < 4 or right else p[3, -1]
        for k in range(4):
            if left:
                p[-1, k] = int(rec[4 * y + k, 4 * x - 1])
        if up and left:
            p[-1, -1] = int(rec[4 * y - 1, 4 * x - 1])
        out = np.zeros((4, 4), np.int64)
        three = lambda a, b, c: (p[a] + 2 * p[b] + p[c] + 2) >> 2
        two = lambda a, b: (p[a] + p[b] + 1) >> 1
        for j in range(4):
            for i in range(4):
                if mode == 0:
                    v = p[i, -1]
                elif mode == 1:
                    v = p[-1, j]
                elif mode == 2:
                    edge = [p[k, -1] for k in range(4) if up] + [p[-1, k] for k in range(4) if left]
                    v = (sum(edge) + len(edge) // 2) // len(edge) if edge else 128
                elif mode == 3:
                    v = (p[6, -1] + 3 * p[7, -1] + 2) >> 2 if i == j == 3 else three((i + j, -1), (i + j + 1, -1), (i + j + 2, -1))
                elif mode == 4:
                    v = three((i - j - 2, -1), (i - j - 1, -1), (i - j, -1)) if i > j else three((-1, j - i - 2), (-1, j - i - 1), (-1, j - i)) if i < j else three((0, -1), (-1, -1), (-1, 0))
                elif mode == 5:
                    z, k = 2 * i - j, i - (j >> 1)
                    v = two((k - 1, -1), (k, -1)) if z >= 0 and z % 2 == 0 else three((k - 2, -1), (k - 1, -1), (k, -1)) if z >= 0 else three((-1, 0), (-1, -1), (0, -1)) if z == -1 else three((-1, j - 1), (-1, j - 2), (-1, j - 3))
                elif mode == 6:
                    z, k = 2 * j - i, j - (i >> 1)
                    v = two((-1, k - 1), (-1, k)) if z >= 0 and z % 2 == 0 else three((-1, k - 2), (-1, k - 1), (-1, k)) if z >= 0 else three((-1, 0), (-1, -1), (0, -1)) if z == -1 else three((i - 1, -1), (i - 2, -1), (i - 3, -1))
                elif mode == 7:
                    k = i + (j >> 1)
                    v = two((k, -1), (k + 1, -1)) if j % 2 == 0 else three((k, -1), (k + 1, -1), (k + 2, -1))
                else:
                    z, k = i + 2 * j, j + (i >> 1)
                    v = p[-1, 3] if z > 5 else (p[-1, 2] + 3 * p[-1, 3] + 2) >> 2 if z == 5 else two((-1, k), (-1, k + 1)) if z % 2 == 0 else three((-1, k), (-1, k + 1), (-1, k + 2))
                out[j, i] = v
        return out

    def intra(self, my, mx, number, qp, r, kind):
        self.kinds.append("intra16")
        top = self.slice_of.get((my - 1, mx)) == number
        assert r.ue() == 0 and r.se() == 0
        dc = np.zeros(16, np.int64)
        dc[np.array(T.ZIGZAG)] = read_block(r, self.nc(0, 4 * my, 4 * mx, number), 16)
        ac = np.zeros((4, 4, 4, 4), np.int64)
        for k in range(16 if kind >= 12 else 0):
            v, u = 2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2
            scan = read_block(r, self.nc(0, 4 * my + v, 4 * mx + u, number), 15)
            self.n[0, 4 * my + v, 4 * mx + u] = int(np.count_nonzero(scan))
            block = np.zeros(16, np.int64)
            block[np.array(T.ZIGZAG)[1:]] = scan
            ac[v, u] = block.reshape(4, 4)
        for k in range(16):
            self.mv[4 * my + k // 4, 4 * mx + k % 4] = (-1, (0, 0))
        self.rec[0][16 * my : 16 * my + 16, 16 * mx : 16 * mx + 16] = E.luma_rebuilt(E.luma_modes(self.rec[0], 16 * my, 16 * mx, top)[kind % 4], dc.reshape(4, 4), ac, qp)
        self.chroma(my, mx, number, qp, r, kind // 4 % 3, [E.chroma_dc(self.rec[k], 8 * my, 8 * mx, top) for k in (1, 2)])

    def filter(self, qp):
        left, upper = (np.zeros((self.h // 4, self.w // 4), np.int64) for _ in range(2))
        for y in range(self.h // 4):
            for x in range(self.w // 4):
                for to, (v, u), outer in ((left, (y, x - 1), x % 4 == 0), (upper, (y - 1, x), y % 4 == 0)):
                    if v < 0 or u < 0:
                        continue
                    (a, m), (b, k) = self.mv[y, x], self.mv[v, u]
                    if a < 0 or b < 0:
                        to[y, x] = 4 if outer else 3
                    elif self.n.get((0, y, x), 0) or self.n.get((0, v, u), 0):
                        to[y, x] = 2
                    else:
                        to[y, x] = abs(m[0] - k[0]) >= 4 or abs(m[1] - k[1]) >= 4
        n = self.h // 16, self.w // 16
        self.ref = K.filtered(tuple(self.rec), left, upper, np.full(n, qp), np.full(n, T.chroma_qp(qp)), O.tables())


def scene(f, w, h, seed=0, noise=4):
    """A moving texture with a square that goes another way, and noise."""
    r = np.random.default_rng(100 * seed + f)
    y, x = np.mgrid[0:h, 0:w]
    luma = (np.sin((x + 1.5 * f) / 3.0) + np.cos((y - 0.75 * f) / 4.0)) * 50 + 128
    at = (5 * f) % (w - 10)
    luma[h // 3 : h // 3 + 9, at : at + 9] = 230
    luma = np.clip(luma + r.integers(-noise, noise + 1, (h, w)), 0, 255).astype(np.int64)
    return luma, (luma[::2, ::2] + luma[1::2, 1::2]) // 2, 255 - luma[::2, ::2]


def split_units(data):
    return [b"\0\0\0\1" + u for u in data.split(b"\0\0\0\1")[1:]]


@pytest.mark.parametrize("w,h,qp,slices", [(48, 32, 20, 1), (64, 48, 28, 2), (48, 48, 36, 3), (32, 32, 12, 2), (48, 32, 44, 1)])
def test_groups_decode_to_the_same_planes(w, h, qp, slices):
    group, decoder, kinds = I.Group(qp, slices, O.tables()), Decoder(w, h), {}
    for f in range(5):
        planes = scene(f, w, h, qp)
        data, p, filtered = group.add(planes)
        units = split_units(data)
        assert len(units) == slices and {u[4] for u in units} == {0x65 if f == 0 else 0x41}
        for a, b, own in zip(decoder.picture(units, qp), filtered, planes):
            assert np.array_equal(a, b)
            assert ((b - own) ** 2).mean() < max(3.0, 0.5 * 2 ** ((qp - 4) / 3))
        if f:
            names = {"skip": "skip", 0: "16x16", 1: "16x8", 2: "8x16", 3: "8x8", "intra4": "intra4", "intra16": "intra16"}
            for k in decoder.kinds:
                kinds[names[k]] = kinds.get(names[k], 0) + 1
            assert len(decoder.kinds) == w * h // 256 and sum(p.counts.values()) == len(decoder.kinds)
    assert len(kinds) > 1


def test_every_kind_of_macroblock_occurs():
    seen = {}
    ramp = np.tile(np.arange(64) * 4, (64, 1))
    cut = ramp, ramp[::2, ::2] // 2, ramp[::2, ::2] // 3 + 9
    for seed, (qp, noise) in enumerate(((16, 0), (26, 1), (30, 12), (24, 60), (40, 0))):
        group, decoder = I.Group(qp, 2, O.tables()), Decoder(64, 64)
        for planes in (scene(0, 64, 64, seed, noise), scene(1, 64, 64, seed, noise), scene(2, 64, 64, seed, noise), cut, cut, cut):
            data, p, filtered = group.add(planes)
            assert all(np.array_equal(a, b) for a, b in zip(decoder.picture(split_units(data), qp), filtered))
            for k, n in p.counts.items():
                seen[k] = seen.get(k, 0) + n
    assert {k for k, n in seen.items() if n} == {"skip", "16x16", "16x8", "8x16", "8x8", "intra4", "intra16"}


def test_still_pictures_are_skipped():
    planes = np.full((32, 48), 90), np.full((16, 24), 60), np.full((16, 24), 200)
    group = I.Group(28, 2, O.tables())
    group.add(planes)
    data, p, filtered = group.add(planes)
    assert p.counts == {"skip": 6} and len(data) < 24 and (filtered[0] == group.reference[0]).all()


def test_exact_prediction_takes_16x16_in_intra_slices():
    flat = np.full((32, 32), 128), np.full((16, 16), 128), np.full((16, 16), 128)
    _, p, _ = I.Group(28, 1, O.tables()).add(flat)
    assert p.counts == {"intra16": 4}
    flat[0][0, 0] = 129
    _, p, _ = I.Group(28, 1, O.tables()).add(flat)
    assert p.counts["intra4"] >= 1


def test_all_modes_of_blocks_occur_and_decode():
    r, seen = np.random.default_rng(3), set()
    y, x = np.mgrid[0:48, 0:64]
    for k in range(12):
        a = k * np.pi / 12
        luma = np.clip(128 + 90 * np.sin((x * np.cos(a) + y * np.sin(a)) / 2.2) + r.integers(-3, 4, (48, 64)), 0, 255).astype(np.int64)
        planes = luma, luma[::2, ::2], luma[1::2, 1::2]
        data, p, filtered = I.Group(18, 2, O.tables()).add(planes)
        seen |= set(p.modes.ravel().tolist())
        assert all(np.array_equal(b, c) for b, c in zip(Decoder(64, 48).picture(split_units(data), 18), filtered))
    assert seen == set(range(9))


def test_what_a_partition_sees():
    g = I.MotionGrid(8, 12)
    assert g.predicted(0, 0, "16x16", 0) == (0, 0) == g.skipped(0, 0, 0)
    g.commit(0, 0, "16x16", (4, 8))
    assert g.predicted(0, 4, "16x16", 0) == (4, 8)  # only the left one is there
    g.commit(0, 4, "top", (6, 2))
    assert g.predicted(2, 4, "bottom", 0) == (4, 8)  # of the left one
    g.commit(0, 4, "bottom", (-2, 0))
    g.commit(0, 8, "16x16", (0, 0), I.INTRA)
    assert g.predicted(4, 4, "16x16", 0) == (-2, 0)  # the upper one alone has the reference
    assert g.predicted(4, 4, "16x16", 4) == (0, 0)  # another slice begins
    g.commit(4, 0, "16x16", (10, -6))
    assert g.predicted(4, 4, "16x16", 0) == (0, 0)  # the median of (10, -6), (-2, 0), intra as 0
    g.commit(4, 4, "q00", (1, 1))
    assert g.predicted(4, 6, "q10", 0) == (0, 0)  # of (1, 1), (-2, 0), intra as 0
    g.commit(4, 4, "q10", (3, 5))
    # The lower left quarter sees the upper right one as its upper right neighbour.
    assert g.around(6, 4, 2, 0) == [(0, (10, -6)), (0, (1, 1)), (0, (3, 5))]
    # The lower right one has nothing to its upper right, so the upper left one.
    g.commit(4, 4, "q01", (7, 7))
    assert g.around(6, 6, 2, 0) == [(0, (7, 7)), (0, (3, 5)), (0, (1, 1))]


def test_from_raw_files_to_movies_and_back(spark, tmp_path):
    """Frames of two sizes through every source and sink: raw video, groups on Spark, byte stream and movie files."""
    from blockflow.operators import session as S
    from blockflow.sources import bytestream as B
    from blockflow.sources.rawvideo import RawVideo

    spark.dataSource.register(RawVideo)
    clips = {0: [scene(f, 48, 32, 1) for f in range(7)], 1: [tuple(p[: 20 if k == 0 else 10, : 30 if k == 0 else 15] for k, p in enumerate(scene(f, 32, 32, 2))) for f in range(5)]}
    frames = None
    for s, clip in clips.items():
        h, w = clip[0][0].shape
        (tmp_path / f"{s}.yuv").write_bytes(b"".join(p.astype(np.uint8).tobytes() for planes in clip for p in planes))
        df = spark.read.format("rawvideo").options(width=w, height=h, partition_bytes=2_000).load(str(tmp_path / f"{s}.yuv")).selectExpr(f"{s}L AS stream_id", "frame_idx", "width", "height", "y", "u", "v")
        frames = df if frames is None else frames.union(df)
    units = S.encode_groups(frames, qp=26, slices=2, interval=4)
    got = {(r.stream_id, r.frame_idx): r for r in units.collect()}
    assert set(got) == {(s, f) for s, clip in clips.items() for f in range(len(clip))} and all(r.idr == (f % 4 == 0) for (_, f), r in got.items())
    B.save_streams(units.withColumn("seq", units["frame_idx"]).withColumn("ticks", units["frame_idx"] * 3_000), str(tmp_path / "h264"))
    B.save_streams(units.withColumn("seq", units["frame_idx"]).withColumn("ticks", units["frame_idx"] * 3_000), str(tmp_path / "mp4"), "mp4")
    found = spark.read.format("annexb").option("partition_bytes", 300).load(str(tmp_path / "h264")).orderBy("path", "offset").collect()
    for s, clip in clips.items():
        own = [r for r in found if r.path.endswith(f"/{s}.h264")]
        h, w = (-(-n // 16) * 16 for n in clip[0][0].shape)
        decoder, k = Decoder(w, h), 0
        for f, planes in enumerate(clip):
            kinds = [7, 8] * (f % 4 == 0) + [5 if f % 4 == 0 else 1] * 2
            assert [r.type for r in own[k : k + len(kinds)]] == kinds and {r.ref_idc for r in own[k : k + len(kinds)]} <= {2, 3}
            slices = [b"\0\0\0\1" + bytes([r.ref_idc << 5 | r.type]) + bytes(r.payload) for r in own[k : k + len(kinds)] if r.type < 6]
            k += len(kinds)
            luma = decoder.picture(slices, 26)[0][: planes[0].shape[0], : planes[0].shape[1]]
            assert int(((luma - planes[0]) ** 2).sum()) == got[s, f].sse
        assert k == len(own)
        # The movie's media data is the slices with lengths.
        movie = (tmp_path / "mp4" / f"{s}.mp4").read_bytes()
        media = b"".join((1 + len(r.payload)).to_bytes(4, "big") + bytes([r.ref_idc << 5 | r.type]) + bytes(r.payload) for r in own if r.type < 6)
        assert movie[36 : 36 + len(media)] == media
