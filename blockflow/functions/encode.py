"""A slice as bits: intra 16x16 macroblocks predicted from what is already decoded, transformed, quantised and coded.

Arithmetic follows the decoding process of the standard, so the reconstruction here is what a decoder gets.
"""

from __future__ import annotations

import numpy as np

from blockflow.functions import tables as T
from blockflow.functions import vlc as V
from blockflow.functions.motion import clipped

_CORE = np.array(T.CORE, np.int64)
_HAD = np.array(T.HADAMARD, np.int64)
_H2 = np.array([[1, 1], [1, -1]], np.int64)
_CLASS = np.array([T.position_class(k) for k in range(16)]).reshape(4, 4)
MF = np.array([[row[c] for c in _CLASS.ravel()] for row in T.QUANT_MF], np.int64).reshape(6, 4, 4)
NORM = np.array([[row[c] for c in _CLASS.ravel()] for row in T.NORM_ADJUST], np.int64).reshape(6, 4, 4)
ZIGZAG = np.array(T.ZIGZAG)
#: Blocks of a macroblock in order of coding, as (row, column).
CODED = [(2 * (k // 8) + k % 4 // 2, 2 * (k // 4 % 2) + k % 2) for k in range(16)]


def ue(n: int) -> str:
    b = format(n + 1, "b")
    return "0" * (len(b) - 1) + b


def se(n: int) -> str:
    return ue(2 * n - 1 if n > 0 else -2 * n)


def residual_bits(levels: list[int], nc: int, dc: bool = False) -> str:
    """A scanned block in context-adaptive codes; dc: the four levels of chroma DC."""
    at = [i for i, v in enumerate(levels) if v]
    table = V.TOKENS[4 if dc else 0 if nc < 2 else 1 if nc < 4 else 2 if nc < 8 else 3]
    if not at:
        return table[0][0]
    back = [int(levels[i]) for i in reversed(at)]
    n, zeros = len(at), at[-1] + 1 - len(at)
    ones = min(3, next((i for i, v in enumerate(back) if abs(v) != 1), n))
    out = [table[n][ones], *("1" if v < 0 else "0" for v in back[:ones])]
    suffix = 1 if n > 10 and ones < 3 else 0
    for i, v in enumerate(back[ones:]):
        code = (2 * v - 2 if v > 0 else -2 * v - 1) - (2 if i == 0 and ones < 3 else 0)
        if suffix == 0 and 14 <= code < 30:
            out.append("0" * 14 + "1" + format(code - 14, "04b"))
        elif code >> suffix >= 15:
            rest = code - (15 << suffix) - (15 if suffix == 0 else 0)
            if rest >> 12:
                raise ValueError("a level is too large for its code")
            out.append("0" * 15 + "1" + format(rest, "012b"))
        else:
            out.append("0" * (code >> suffix) + "1" + (format(code & (1 << suffix) - 1, f"0{suffix}b") if suffix else ""))
        suffix = max(1, suffix)
        suffix += suffix < 6 and abs(v) > 3 << suffix - 1
    if n < len(levels):
        out.append((V.TOTAL_ZEROS_DC if dc else V.TOTAL_ZEROS)[n - 1][zeros])
    for i in range(n - 1):
        if zeros > 0:
            run = at[n - 1 - i] - at[n - 2 - i] - 1
            out.append(V.RUNS[min(zeros, 7) - 1][run])
            zeros -= run
    return "".join(out)


def _blocks(a: np.ndarray) -> np.ndarray:
    """(n, n, 4, 4) blocks of a square."""
    n = len(a) // 4
    return a.reshape(n, 4, n, 4).swapaxes(1, 2)


def _joined(b: np.ndarray) -> np.ndarray:
    n = len(b)
    return b.swapaxes(1, 2).reshape(4 * n, 4 * n)


def _quantised(c: np.ndarray, mf, shift: int) -> np.ndarray:
    return np.sign(c) * ((np.abs(c) * mf + (1 << shift) // 3) >> shift)


def _inverse(d: np.ndarray) -> np.ndarray:
    """Residuals of dequantised blocks (..., 4, 4)."""
    def one(x):
        e, f = x[..., 0] + x[..., 2], x[..., 0] - x[..., 2]
        g, h = (x[..., 1] >> 1) - x[..., 3], x[..., 1] + (x[..., 3] >> 1)
        out = np.empty_like(x)
        out[..., 0], out[..., 1], out[..., 2], out[..., 3] = e + h, f + g, f - g, e - h
        return out

    return (one(one(d).swapaxes(-1, -2)).swapaxes(-1, -2) + 32) >> 6


def dequantised(levels: np.ndarray, qp: int) -> np.ndarray:
    """Coefficients of 4x4 levels without a chained DC."""
    d = levels * 16 * NORM[qp % 6]
    return d << (qp // 6 - 4) if qp >= 24 else (d + (1 << (3 - qp // 6))) >> (4 - qp // 6)


def luma_rebuilt(pred: np.ndarray, dc: np.ndarray, ac: np.ndarray, qp: int) -> np.ndarray:
    """Prediction plus residual: dc (4, 4) levels, ac (4, 4, 4, 4) levels without their first."""
    f = _HAD @ dc @ _HAD
    scale = 16 * int(NORM[qp % 6, 0, 0])
    d = dequantised(ac, qp)
    d[..., 0, 0] = (f * scale) << (qp // 6 - 6) if qp >= 36 else (f * scale + (1 << (5 - qp // 6))) >> (6 - qp // 6)
    return clipped(pred + _joined(_inverse(d)), 0, 255)


def chroma_rebuilt(pred: np.ndarray, dc: np.ndarray, ac: np.ndarray, qp: int) -> np.ndarray:
    f = _H2 @ dc @ _H2
    d = dequantised(ac, qp)
    d[..., 0, 0] = ((f * 16 * int(NORM[qp % 6, 0, 0])) << (qp // 6)) >> 5
    return clipped(pred + _joined(_inverse(d)), 0, 255)


def luma_modes(rec: np.ndarray, y: int, x: int, top: bool) -> dict[int, np.ndarray]:
    """Intra 16x16 predictions (vertical, horizontal, DC, plane) from decoded samples. top: whether the row above is in the slice."""
    left = x > 0
    above, side = rec[y - 1, x : x + 16] if top else None, rec[y : y + 16, x - 1] if left else None
    edge = [e for e in (above, side) if e is not None]
    out = {2: np.full((16, 16), (sum(int(e.sum()) for e in edge) + 8 * len(edge)) // (16 * len(edge)) if edge else 128)}
    if top:
        out[0] = np.tile(above, (16, 1))
    if left:
        out[1] = np.tile(side[:, None], (1, 16))
    if top and left:
        corner, k = int(rec[y - 1, x - 1]), np.arange(1, 9)
        far = lambda e: int((k * (e[8:16] - np.append(e[6::-1], corner))).sum())
        b, c, a = (5 * far(above) + 32) >> 6, (5 * far(side) + 32) >> 6, 16 * int(above[15] + side[15])
        g = np.arange(16) - 7
        out[3] = clipped((a + b * g[None, :] + c * g[:, None] + 16) >> 5, 0, 255)
    return out


def chroma_dc(rec: np.ndarray, y: int, x: int, top: bool) -> np.ndarray:
    """The DC prediction of an 8x8 chroma block, quadrant by quadrant."""
    left = x > 0
    t = [int(rec[y - 1, x + 4 * k : x + 4 * k + 4].sum()) for k in (0, 1)] if top else None
    s = [int(rec[y + 4 * k : y + 4 * k + 4, x - 1].sum()) for k in (0, 1)] if left else None
    out = np.full((8, 8), 128, np.int64)
    for r in (0, 1):
        for c in (0, 1):
            if t and s and r == c:
                v = (t[c] + s[r] + 4) >> 3
            elif t and (not s or c > r):
                v = (t[c] + 2) >> 2
            elif s:
                v = (s[r] + 2) >> 2
            else:
                continue
            out[4 * r : 4 * r + 4, 4 * c : 4 * c + 4] = v
    return out


def slice_header(first: int, idr_pic_id: int, qp_delta: int, filter_idc: int = 1) -> str:
    """An IDR slice of type I; parameter set 0, frame_num 0 in four bits."""
    return ue(first) + ue(7) + ue(0) + "0000" + ue(idr_pic_id) + "00" + se(qp_delta) + ue(filter_idc) + ("" if filter_idc == 1 else "11")


def _context(counts: np.ndarray, r: int, c: int, first: int) -> int:
    a = counts[r, c - 1] if c else -1
    b = counts[r - 1, c] if r > first else -1
    return int(max(a, b, 0) if min(a, b) < 0 else (a + b + 1) >> 1)


Chroma = list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # prediction, DC levels, AC levels of both planes


def chroma_levels(own: np.ndarray, pred: np.ndarray, cqp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An 8x8 chroma block in one step: prediction, levels of the chained DC and of the AC of its four parts."""
    c = _CORE @ _blocks(own - pred) @ _CORE.T
    dc = _quantised(_H2 @ c[..., 0, 0] @ _H2, int(MF[cqp % 6, 0, 0]), 16 + cqp // 6)
    ac = _quantised(c, MF[cqp % 6], 15 + cqp // 6)
    ac[..., 0, 0] = 0
    return pred, dc, ac


def chroma_pattern(chroma: Chroma) -> int:
    return 2 if any(a.any() for _, _, a in chroma) else 1 if any(d.any() for _, d, _ in chroma) else 0


def chroma_bits(chroma: Chroma, pattern: int, counts: np.ndarray, my: int, mx: int, first_row: int) -> list[str]:
    """Codes of the chroma levels of a macroblock; counts (2, rows, columns) of 4x4 blocks are brought up to date."""
    out = [residual_bits(d.ravel().tolist(), -1, dc=True) for _, d, _ in chroma] if pattern else []
    for k, (_, _, a) in enumerate(chroma if pattern == 2 else ()):
        for r, c in ((0, 0), (0, 1), (1, 0), (1, 1)):
            levels = a[r, c].ravel()[ZIGZAG][1:].tolist()
            out.append(residual_bits(levels, _context(counts[k], 2 * my + r, 2 * mx + c, 2 * first_row)))
            counts[k][2 * my + r, 2 * mx + c] = np.count_nonzero(levels)
    return out


def encoded(planes: tuple[np.ndarray, np.ndarray, np.ndarray], first_row: int, rows: int, qp: int, idr_pic_id: int = 0, filter_idc: int = 1) -> tuple[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bits of the slice of macroblock rows [first_row, first_row + rows), trailing bits included, and the decoded planes of those rows."""
    src = [p.astype(np.int64) for p in planes]
    rec = [np.zeros_like(p) for p in src]
    h, w = src[0].shape
    cqp = T.chroma_qp(qp)
    luma_n, chroma_n = np.zeros((h // 4, w // 4), np.int64), np.zeros((2, h // 8, w // 8), np.int64)
    out = [slice_header(first_row * (w // 16), idr_pic_id, qp - 26, filter_idc)]
    for my in range(first_row, first_row + rows):
        for mx in range(w // 16):
            y, x, top = 16 * my, 16 * mx, my > first_row
            own = src[0][y : y + 16, x : x + 16]
            modes = luma_modes(rec[0], y, x, top)
            mode = min((m for m in (2, 0, 1, 3) if m in modes), key=lambda m: np.abs(own - modes[m]).sum())
            coef = _CORE @ _blocks(own - modes[mode]) @ _CORE.T
            dc = _quantised(_HAD @ coef[..., 0, 0] @ _HAD, int(MF[qp % 6, 0, 0]), 17 + qp // 6)
            ac = _quantised(coef, MF[qp % 6], 15 + qp // 6)
            ac[..., 0, 0] = 0
            has_ac = bool(ac.any())
            chroma = [chroma_levels(src[k][y // 2 : y // 2 + 8, x // 2 : x // 2 + 8], chroma_dc(rec[k], y // 2, x // 2, top), cqp) for k in (1, 2)]
            pattern = chroma_pattern(chroma)
            out += [ue(1 + mode + 4 * pattern + 12 * has_ac), ue(0), se(0)]
            out.append(residual_bits(dc.ravel()[ZIGZAG].tolist(), _context(luma_n, 4 * my, 4 * mx, 4 * first_row)))
            for r, c in CODED if has_ac else ():
                levels = ac[r, c].ravel()[ZIGZAG][1:].tolist()
                out.append(residual_bits(levels, _context(luma_n, 4 * my + r, 4 * mx + c, 4 * first_row)))
                luma_n[4 * my + r, 4 * mx + c] = np.count_nonzero(levels)
            out += chroma_bits(chroma, pattern, chroma_n, my, mx, first_row)
            rec[0][y : y + 16, x : x + 16] = luma_rebuilt(modes[mode], dc, ac, qp)
            for k, (pred, d, a) in enumerate(chroma, 1):
                rec[k][y // 2 : y // 2 + 8, x // 2 : x // 2 + 8] = chroma_rebuilt(pred, d, a if pattern == 2 else a * 0, cqp)
    bits = "".join(out) + "1"
    return bits + "0" * (-len(bits) % 8), tuple(p[(16 >> (k > 0)) * first_row : (16 >> (k > 0)) * (first_row + rows)] for k, p in enumerate(rec))


def unit(header: int, bits: str) -> bytes:
    """A unit of the byte stream: start code, header, payload with emulation prevention."""
    data, out, zeros = int(bits, 2).to_bytes(len(bits) // 8, "big"), bytearray(b"\0\0\0\1" + bytes([header])), 0
    for b in data:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)
