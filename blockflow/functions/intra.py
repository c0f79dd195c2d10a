"""Intra 4x4 macroblocks: each 4x4 block predicted from what is decoded already, also within its macroblock, in one of nine modes.

Modes are shortlisted by absolute differences and chosen by transformed differences and the bits of the mode, which depend on the
modes of the blocks around. A block is rebuilt before the next one is predicted.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from blockflow.functions import encode as E
from blockflow.functions import motion as K
from blockflow.functions import tables as T
from blockflow.functions import vlc as V

DC, ABSENT = 2, -1
#: Modes that are scored by transformed differences, and what a mode costs in bits where it is the expected one and where it is not.
SHORTLIST, EXPECTED_BITS, OTHER_BITS = 3, 1, 4
_PLACE = {rc: k for k, rc in enumerate(E.CODED)}
_CODE = {pattern: n for n, pattern in enumerate(V.CBP_INTRA)}


@cache
def _rules():
    """Weights of all modes, their shifts and what is added before."""
    from blockflow.operators import intra4

    weights, shifts = intra4._weights()
    return weights.reshape(144, 13), shifts.ravel(), (1 << shifts.ravel()) >> 1


@cache
def _allowed(row: int, col: int) -> tuple[int, ...]:
    """Modes of a block of a slice, by its place in a macroblock of the first or of a later row and column."""
    from blockflow.operators import intra4

    return tuple(m for m in range(9) if intra4.allowed(m, row, col))


def right_above(row4: int, col4: int, first: int, cols: int) -> bool:
    """Whether the four samples to the right above a block are decoded: earlier in the order of coding, or of a macroblock above."""
    r, c = row4 % 4, col4 % 4
    if r == 0:
        return row4 > first and (c < 3 or col4 + 1 < cols)
    return c < 3 and _PLACE[r - 1, c + 1] < _PLACE[r, c]


def predictions(rec: np.ndarray, row4: int, col4: int, first: int) -> dict[int, np.ndarray]:
    """mode -> prediction of a 4x4 block, from decoded samples of its slice (which begins at row `first` of 4x4 blocks)."""
    weights, shifts, half = _rules()
    y, x, above, left = 4 * row4, 4 * col4, row4 > first, col4 > 0
    s = np.zeros(13, np.int64)
    if above:
        s[1:5] = rec[y - 1, x : x + 4]
        s[5:9] = rec[y - 1, x + 4 : x + 8] if right_above(row4, col4, first, rec.shape[1] // 4) else s[4]
        s[0] = rec[y - 1, x - 1] if left else 0
    if left:
        s[9:13] = rec[y : y + 4, x - 1]
    n = 4 * (above + left)
    dc = (int(s[1:5].sum() * above + s[9:13].sum()) + n // 2) // n if n else 128
    every = ((weights @ s + half) >> shifts).reshape(9, 4, 4)
    every[DC] = dc
    row = row4 - first
    return {m: every[m] for m in _allowed(row if row < 4 else 4 + row % 4, col4 if col4 < 4 else 4 + col4 % 4)}


def expected(modes: np.ndarray, r: int, c: int, first: int) -> int:
    """The mode expected of a block: the smaller of its neighbours', DC where one is not in the slice."""
    a = modes[r, c - 1] if c else ABSENT
    b = modes[r - 1, c] if r > first else ABSENT
    return DC if ABSENT in (a, b) else int(min(a, b))


def chosen(own: np.ndarray, found: dict[int, np.ndarray], likely: int, lam: int) -> tuple[int, int]:
    """(mode, absolute difference): of the SHORTLIST modes of smallest absolute difference that of smallest cost, of equal ones the highest."""
    r = own - np.array(list(found.values()))
    sads = dict(zip(found, np.abs(r).sum(axis=(1, 2)).tolist()))
    short = sorted(sads, key=lambda m: (sads[m], m))[:SHORTLIST]
    satds = K.satd_atoms(r[[list(found).index(m) for m in short]].astype(np.int32)).ravel().tolist()
    cost = {m: t + lam * (EXPECTED_BITS if m == likely else OTHER_BITS) for m, t in zip(short, satds)}
    mode = min(short, key=lambda m: (cost[m], -m))
    return mode, sads[mode]


def macroblock(rec: np.ndarray, src: np.ndarray, modes: np.ndarray, my: int, mx: int, first_row: int, qp: int) -> tuple[np.ndarray, list[str], int]:
    """Levels (4, 4, 4, 4), codes of the modes, and the absolute difference of all sixteen blocks. rec and modes are brought up to date."""
    levels, out, total, first = np.zeros((4, 4, 4, 4), np.int64), [], 0, 4 * first_row
    for r, c in E.CODED:
        row4, col4 = 4 * my + r, 4 * mx + c
        at = slice(4 * row4, 4 * row4 + 4), slice(4 * col4, 4 * col4 + 4)
        found, likely = predictions(rec, row4, col4, first), expected(modes, row4, col4, first)
        mode, sad = chosen(src[at], found, likely, T.LAMBDA_SAD[qp])
        out.append("1" if mode == likely else "0" + format(mode - (mode > likely), "03b"))
        modes[row4, col4], total = mode, total + sad
        levels[r, c] = E._quantised(E._CORE @ (src[at] - found[mode]) @ E._CORE.T, E.MF[qp % 6], 15 + qp // 6)
        rec[at] = K.clipped(found[mode] + E._inverse(E.dequantised(levels[r, c], qp)), 0, 255)
    return levels, out, total


def pattern_code(pattern: int) -> str:
    """The code of a coded block pattern of an intra 4x4 macroblock."""
    return E.ue(_CODE[pattern])
