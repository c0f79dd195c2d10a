"""Slices of groups of pictures: macroblocks predicted from the picture before, with vectors and coefficients coded in the context of their slice.

A picture is encoded slice by slice against one filtered picture; the in-loop filter runs when all slices are there, and its
result is the reference of the next picture. What a picture needs of the former one is that reference and the vectors found, so a group of
pictures that begins with an intra picture is a fold of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from blockflow.functions import encode as E
from blockflow.functions import intra as A
from blockflow.functions import motion as K
from blockflow.functions import tables as T
from blockflow.functions import vlc as V

#: Reference numbers of 4x4 blocks that have none: not coded yet, intra.
ABSENT, INTRA = -2, -1
#: Range of the search in whole samples, and how much an intra macroblock must be better, in absolute differences, by the Lagrange factor.
REACH, INTRA_BIAS = 8, 16
_CODE = {pattern: n for n, pattern in enumerate(V.CBP_INTER)}


class MotionGrid:
    """Vectors and reference numbers of the 4x4 blocks of a picture, as far as they are coded.

    A neighbour counts if it lies in the picture, in the slice and is coded already: inside a macroblock that is the order of
    its partitions, so what a partition may see needs no rule of its own.
    """

    def __init__(self, rows: int, cols: int):
        self.mv, self.ref = np.zeros((rows, cols, 2), np.int64), np.full((rows, cols), ABSENT)

    def at(self, r: int, c: int, first: int) -> tuple[int, tuple[int, int]]:
        """(reference, vector) of a 4x4 block, seen from a slice that begins at row `first`."""
        if r < first or c < 0 or c >= self.ref.shape[1] or r >= self.ref.shape[0]:
            return ABSENT, (0, 0)
        return int(self.ref[r, c]), (int(self.mv[r, c, 0]), int(self.mv[r, c, 1]))

    def around(self, r: int, c: int, width: int, first: int) -> list[tuple[int, tuple[int, int]]]:
        """Left, upper and upper right neighbour of a partition; the upper left one where the right one is not coded."""
        right = self.at(r - 1, c + width, first)
        return [self.at(r, c - 1, first), self.at(r - 1, c, first), right if right[0] != ABSENT else self.at(r - 1, c - 1, first)]

    def predicted(self, r: int, c: int, shape: str, first: int, ref: int = 0) -> tuple[int, int]:
        """The vector expected for a partition of `shape` whose first 4x4 block is (r, c)."""
        near = self.around(r, c, K.SHAPES[shape][2] // 4, first)
        side = {"top": 1, "bottom": 0, "left": 0, "right": 2}.get(shape)
        if side is not None and near[side][0] == ref:
            return near[side][1]
        if near[1][0] == near[2][0] == ABSENT != near[0][0]:
            return near[0][1]
        same = [mv for k, mv in near if k == ref]
        if len(same) == 1:
            return same[0]
        x, y = (sorted(v[1][k] for v in near)[1] for k in (0, 1))
        return x, y

    def skipped(self, r: int, c: int, first: int) -> tuple[int, int]:
        """The vector of a macroblock that is not coded at all."""
        left, upper = self.at(r, c - 1, first), self.at(r - 1, c, first)
        if ABSENT in (left[0], upper[0]) or (0, (0, 0)) in (left, upper):
            return 0, 0
        return self.predicted(r, c, "16x16", first)

    def commit(self, r: int, c: int, shape: str, mv: tuple[int, int], ref: int = 0) -> None:
        """Every 4x4 block of a partition of the macroblock whose first 4x4 block is (r, c)."""
        x, y, w, h = (n // 4 for n in K.SHAPES[shape])
        self.mv[r + y : r + y + h, c + x : c + x + w], self.ref[r + y : r + y + h, c + x : c + x + w] = mv, ref


def p_header(first: int, frame_num: int, qp_delta: int) -> str:
    """A slice of type P with one reference, a reference itself; the filter runs over all edges."""
    return E.ue(first) + E.ue(5) + E.ue(0) + format(frame_num % 16, "04b") + "00" + "0" + E.se(qp_delta) + E.ue(0) + "11"


def luma_rebuilt(pred: np.ndarray, levels: np.ndarray, qp: int) -> np.ndarray:
    """Prediction plus residual of (4, 4, 4, 4) levels without a chained DC."""
    return K.clipped(pred + E._joined(E._inverse(E.dequantised(levels, qp))), 0, 255)


@dataclass
class Picture:
    """What is known of a picture while its slices are encoded."""

    rec: list[np.ndarray]
    motion: MotionGrid
    luma: np.ndarray
    chroma: np.ndarray
    modes: np.ndarray  # of 4x4 blocks; DC where a macroblock is of another kind
    counts: dict[str, int] = field(default_factory=dict)

    @classmethod
    def new(cls, planes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Picture:
        h, w = planes[0].shape
        return cls([np.zeros(p.shape, np.int64) for p in planes], MotionGrid(h // 4, w // 4), np.zeros((h // 4, w // 4), np.int64), np.zeros((2, h // 8, w // 8), np.int64), np.full((h // 4, w // 4), A.DC))

    def seen(self, kind: str) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1


def _luma_bits(levels: np.ndarray, pattern: int, p: Picture, my: int, mx: int, first_row: int) -> list[str]:
    """Codes of the 4x4 blocks in the quarters that the pattern names, in the order of coding."""
    out = []
    for k, (r, c) in enumerate(E.CODED):
        if pattern >> k // 4 & 1:
            scan = levels[r, c].ravel()[E.ZIGZAG].tolist()
            out.append(E.residual_bits(scan, E._context(p.luma, 4 * my + r, 4 * mx + c, 4 * first_row)))
            p.luma[4 * my + r, 4 * mx + c] = np.count_nonzero(scan)
    return out


def _intra_macroblock(p: Picture, src: list[np.ndarray], my: int, mx: int, first_row: int, qp: int, among: int) -> list[str]:
    """An intra macroblock. among: how many kinds of macroblock the slice has before the intra ones.

    16x16 where its prediction and those of all 4x4 blocks are exact in an intra slice, where it is the better one in an inter slice.
    """
    y, x, cqp = 16 * my, 16 * mx, T.chroma_qp(qp)
    own, half = (slice(y, y + 16), slice(x, x + 16)), (slice(y // 2, y // 2 + 8), slice(x // 2, x // 2 + 8))
    whole = E.luma_modes(p.rec[0], y, x, my > first_row)
    mode = min((m for m in (2, 0, 1, 3) if m in whole), key=lambda m: np.abs(src[0][own] - whole[m]).sum())
    sad = int(np.abs(src[0][own] - whole[mode]).sum())
    chroma = [E.chroma_levels(src[k][half], E.chroma_dc(p.rec[k], y // 2, x // 2, my > first_row), cqp) for k in (1, 2)]
    pattern = E.chroma_pattern(chroma)
    levels, codes, sads = A.macroblock(p.rec[0], src[0], p.modes, my, mx, first_row, qp)
    if sad == 0 == sads if among == 0 else sad <= sads + A.OTHER_BITS * 16 * T.LAMBDA_SAD[qp]:
        p.modes[4 * my : 4 * my + 4, 4 * mx : 4 * mx + 4] = A.DC
        coef = E._CORE @ E._blocks(src[0][own] - whole[mode]) @ E._CORE.T
        dc = E._quantised(E._HAD @ coef[..., 0, 0] @ E._HAD, int(E.MF[qp % 6, 0, 0]), 17 + qp // 6)
        ac = E._quantised(coef, E.MF[qp % 6], 15 + qp // 6)
        ac[..., 0, 0] = 0
        has_ac = bool(ac.any())
        out = [E.ue(among + 1 + mode + 4 * pattern + 12 * has_ac), E.ue(0), E.se(0), E.residual_bits(dc.ravel()[E.ZIGZAG].tolist(), E._context(p.luma, 4 * my, 4 * mx, 4 * first_row))]
        for r, c in E.CODED if has_ac else ():
            scan = ac[r, c].ravel()[E.ZIGZAG][1:].tolist()
            out.append(E.residual_bits(scan, E._context(p.luma, 4 * my + r, 4 * mx + c, 4 * first_row)))
            p.luma[4 * my + r, 4 * mx + c] = np.count_nonzero(scan)
        p.rec[0][own] = E.luma_rebuilt(whole[mode], dc, ac, qp)
        p.seen("intra16")
    else:
        quarters = _quarters(levels)
        out = [E.ue(among), *codes, E.ue(0), A.pattern_code(quarters + 16 * pattern)]
        if quarters or pattern:
            out += [E.se(0), *_luma_bits(levels, quarters, p, my, mx, first_row)]
        p.seen("intra4")
    out += E.chroma_bits(chroma, pattern, p.chroma, my, mx, first_row)
    for k, (cp, d, a) in enumerate(chroma, 1):
        p.rec[k][half] = E.chroma_rebuilt(cp, d, a if pattern == 2 else a * 0, cqp)
    p.motion.commit(4 * my, 4 * mx, "16x16", (0, 0), INTRA)
    return out


def _quarters(levels: np.ndarray) -> int:
    """Which 8x8 quarters of a macroblock have levels, as bits."""
    return sum(1 << k for k in range(4) if levels[2 * (k // 2) : 2 * (k // 2) + 2, 2 * (k % 2) : 2 * (k % 2) + 2].any())


def intra_encoded(planes, p: Picture, first_row: int, rows: int, qp: int, idr_pic_id: int) -> str:
    """Bits of the intra slice of macroblock rows [first_row, first_row + rows), trailing bits included; `p` gets what is decoded."""
    src = [a.astype(np.int64) for a in planes]
    n_cols = src[0].shape[1] // 16
    out = [E.slice_header(first_row * n_cols, idr_pic_id, qp - 26, 0)]
    for my in range(first_row, first_row + rows):
        for mx in range(n_cols):
            out += _intra_macroblock(p, src, my, mx, first_row, qp, 0)
    bits = "".join(out) + "1"
    return bits + "0" * (-len(bits) % 8)


def encoded(planes, refs, former: MotionGrid | None, p: Picture, first_row: int, rows: int, qp: int, frame_num: int, satd: bool = True, sub: bool = True, known: dict | None = None) -> str:
    """Bits of the inter slice of macroblock rows [first_row, first_row + rows), trailing bits included; `p` gets what is decoded.
    satd, sub: whether the search ranks by transformed differences, and whether it tries smaller shapes.

    refs: the padded planes of the reference. former: the vectors of the picture before, each the seed of the macroblock at its place.
    known: what follows from the picture and the reference alone, for the other slices and whoever encodes the same with other settings.
    """
    known = {} if known is None else known
    src = [a.astype(np.int64) for a in planes]
    n_cols, lam, cqp = src[0].shape[1] // 16, T.LAMBDA_SATD[qp], T.chroma_qp(qp)
    if "quarters" not in known:
        known["quarters"] = K.quarters(refs[0])
    between = known["quarters"]
    out, run, first = [p_header(first_row * n_cols, frame_num, qp - 26)], 0, 4 * first_row
    for my in range(first_row, first_row + rows):
        for mx in range(n_cols):
            y, x, r, c = 16 * my, 16 * mx, 4 * my, 4 * mx
            own = src[0][y : y + 16, x : x + 16]
            if (y, x, satd) not in known:
                known[y, x, satd] = K.Block(own, refs[0], x + K.HALO, y + K.HALO, REACH, satd, between)
            block = known[y, x, satd]
            expected = tuple(max(-4 * REACH, min(4 * REACH, v)) for v in p.motion.predicted(r, c, "16x16", first))
            seed = former.at(r, c, 0) if former else (ABSENT, (0, 0))
            part, total, vectors = K.search(block, lam, REACH, expected, seed[1] if seed[0] >= 0 else None, sub=sub)
            modes = E.luma_modes(p.rec[0], y, x, my > first_row)
            mode = min((m for m in (2, 0, 1, 3) if m in modes), key=lambda m: np.abs(own - modes[m]).sum())
            if int(np.abs(own - modes[mode]).sum()) + INTRA_BIAS * T.LAMBDA_SAD[qp] < total:
                out += [E.ue(run), *_intra_macroblock(p, src, my, mx, first_row, qp, 5)]
                run = 0
                continue
            pred = [a.astype(np.int64) for a in K.predicted(refs, x, y, part, vectors, quarters=between)]
            levels = E._quantised(E._CORE @ E._blocks(own - pred[0]) @ E._CORE.T, E.MF[qp % 6], 15 + qp // 6)
            half = slice(y // 2, y // 2 + 8), slice(x // 2, x // 2 + 8)
            chroma = [E.chroma_levels(src[k][half], pred[k], cqp) for k in (1, 2)]
            quarters = _quarters(levels)
            pattern = quarters + 16 * E.chroma_pattern(chroma)
            if part == 0 and not pattern and tuple(vectors[0]) == p.motion.skipped(r, c, first):
                run += 1
                p.motion.commit(r, c, "16x16", vectors[0])
                p.seen("skip")
            else:
                out += [E.ue(run), E.ue(part), "1" * 4 * (part == 3)]  # of four 8x8 quarters, none is divided further
                run = 0
                for shape, mv in zip(K.PARTS[part], vectors):
                    bx, by = K.SHAPES[shape][:2]
                    expected = p.motion.predicted(r + by // 4, c + bx // 4, shape, first)
                    out += [E.se(mv[0] - expected[0]), E.se(mv[1] - expected[1])]
                    p.motion.commit(r, c, shape, mv)
                out.append(E.ue(_CODE[pattern]))
                if pattern:
                    out += [E.se(0), *_luma_bits(levels, quarters, p, my, mx, first_row), *E.chroma_bits(chroma, pattern >> 4, p.chroma, my, mx, first_row)]
                p.seen(("16x16", "16x8", "8x16", "8x8")[part])
            p.rec[0][y : y + 16, x : x + 16] = luma_rebuilt(pred[0], levels, qp)
            for k, (cp, d, a) in enumerate(chroma, 1):
                p.rec[k][half] = E.chroma_rebuilt(cp, d, a if pattern >> 4 == 2 else a * 0, cqp)
    if run:
        out.append(E.ue(run))
    bits = "".join(out) + "1"
    return bits + "0" * (-len(bits) % 8)


def strengths(motion: MotionGrid, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the left and of the upper edge of each 4x4 block, over the whole picture; edges of the picture have none."""
    def along(ref: np.ndarray, mv: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros(ref.shape, np.int64)
        intra = (ref[:, 1:] == INTRA) | (ref[:, :-1] == INTRA)
        outer = np.arange(1, ref.shape[1]) % 4 == 0
        moved = (np.abs(mv[:, 1:] - mv[:, :-1]) >= 4).any(axis=2) | (ref[:, 1:] != ref[:, :-1])
        out[:, 1:] = np.where(intra, np.where(outer, 4, 3), np.where((n[:, 1:] > 0) | (n[:, :-1] > 0), 2, moved))
        return out

    return along(motion.ref, motion.mv, counts), along(motion.ref.T, motion.mv.swapaxes(0, 1), counts.T).T


def filtered(p: Picture, qp: int, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The picture after the in-loop filter, at one QP."""
    n = p.rec[0].shape[0] // 16, p.rec[0].shape[1] // 16
    return K.filtered(tuple(p.rec), *strengths(p.motion, p.luma), np.full(n, qp), np.full(n, T.chroma_qp(qp)), tables)


class Group:
    """A group of pictures: an intra picture, then inter ones, each against the filtered one before."""

    def __init__(self, qp: int, slices: int, tables, idr_pic_id: int = 0):
        self.qp, self.slices, self.tables, self.idr_pic_id = qp, slices, tables, idr_pic_id
        self.number, self.reference, self.motion = 0, None, None
        self.known = None  # as in encoded(), where several groups go on from one picture with the same next one

    def restart(self) -> None:
        """The next picture is an intra one, numbered anew."""
        if self.reference is not None:
            self.number, self.reference, self.motion, self.idr_pic_id = 0, None, None, 1 - self.idr_pic_id

    def add(self, planes: tuple[np.ndarray, np.ndarray, np.ndarray], qp: int | None = None, **search: bool) -> tuple[bytes, Picture, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The slices of the picture as units, what it is made of, and its filtered planes. qp: of this picture; search: as in encoded()."""
        rows, p, units, qp = planes[0].shape[0] // 16, Picture.new(planes), [], self.qp if qp is None else qp
        cuts = [rows * k // self.slices for k in range(self.slices + 1)]
        known, self.known = {} if self.known is None else self.known, None
        if self.reference is not None and "refs" not in known:
            known["refs"] = K.padded(self.reference[0]), *(K.padded(a, K.HALO // 2) for a in self.reference[1:])
        refs = known.get("refs")
        for a, b in ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b):
            if refs is None:
                units.append(E.unit(0x65, intra_encoded(planes, p, a, b - a, qp, self.idr_pic_id)))
            else:
                units.append(E.unit(0x41, encoded(planes, refs, self.motion, p, a, b - a, qp, self.number, known=known, **search)))
        self.reference, self.motion = filtered(p, qp, self.tables), p.motion
        self.number += 1
        return b"".join(units), p, self.reference
