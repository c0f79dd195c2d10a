"""Intra 4x4 prediction inside frames: which samples there are, what stands in for others, and what the modes cost.

A row is a frame; its blocks are predicted from the source samples around them.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
from pyspark.sql import functions as F

from blockflow.functions import motion as K
from blockflow.operators import blockmath as M
from blockflow.operators import decisions as D
from blockflow.operators import frames as R
from blockflow.operators.motion import by_frame
from blockflow.sources import adapters as A

W, H = A.PLANE_WIDTH, A.PLANE_HEIGHT
NAMES = ("Q", *(f"T{k}" for k in range(8)), *(f"L{k}" for k in range(4)))


def _weights() -> tuple[np.ndarray, np.ndarray]:
    """(9, 16, 13) weights of the neighbours and (9, 16) shifts; DC is set apart."""
    w, s = np.zeros((9, 16, 13), np.int64), np.zeros((9, 16), np.int64)
    for m in range(9):
        for y in range(4):
            for x in range(4):
                taps, s[m, 4 * y + x] = R._taps(m, x, y)
                for n, v in taps.items():
                    w[m, 4 * y + x, NAMES.index(n)] += v
    return w, s


_ORDER = np.array(D._ORDER)


def right_above(row4: int, col4: int) -> bool:
    """Whether the four samples to the right above a block are there already: in order of coding, not in column 3 but at the top of a macroblock."""
    r, c = row4 % 4, col4 % 4
    if row4 == 0:
        return False
    if c == 3:
        return r == 0 and col4 // 4 + 1 < W // 16
    return r == 0 or bool(_ORDER[4 * (r - 1) + c + 1] < _ORDER[4 * r + c])


def allowed(mode: int, row4: int, col4: int) -> bool:
    """Modes that read only what is there, less those that the encoder leaves out at the edges of a picture."""
    left, above, r, c = col4 > 0, row4 > 0, row4 % 4, col4 % 4
    left_mb, above_mb = col4 >= 4, row4 >= 4
    if mode in (1, 8, 4, 5, 6) and not left or mode in (0, 3, 7, 4, 5, 6) and not above:
        return False
    if mode in (1, 8):
        return above_mb and (left_mb or not (r == 0 and c == 2 or r == 2 and c in (0, 2)))
    return mode == 2 or above_mb or not (r == 1 and c <= 1)


@cache
def _layout() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of a frame in raster order: where each of the 13 neighbours lies in the plane (behind its end where there is none), how many samples
    DC has, and row, column and mode of every allowed mode."""
    near, count, modes = [], [], []
    for row4 in range(H // 4):
        for col4 in range(W // 4):
            at = lambda dx, dy: (4 * row4 + dy) * W + 4 * col4 + dx  # noqa: E731, B023
            none, far = W * H, right_above(row4, col4)
            above = [at(k, -1) if k < 4 or far else at(3, -1) for k in range(8)] if row4 else [none] * 8
            corner = (at(-1, -1) if col4 else above[0]) if row4 else none
            near.append([corner, *above, *(at(-1, k) if col4 else none for k in range(4))])
            count.append(4 * (row4 > 0) + 4 * (col4 > 0))
            modes += [(row4, col4, m) for m in range(9) if allowed(m, row4, col4)]
    return np.array(near), np.array(count), *np.array(modes).T


def frame_modes(px: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row4, col4, mode, SAD and SATD of the allowed modes of all blocks of a frame."""
    near, count, row4, col4, mode = _layout()
    px = px.astype(np.int32)
    s = np.append(px, 0)[near]
    # Sums of samples by small weights are exact in single precision.
    taps = (s.astype(np.float32) @ weights[0].reshape(144, 13).T.astype(np.float32)).astype(np.int32)
    shifts = weights[1].ravel()
    found = ((taps + ((1 << shifts) >> 1)) >> shifts).reshape(-1, 9, 16)
    found[:, 2] = np.where(count, (s[:, 1:5].sum(axis=1) + s[:, 9:].sum(axis=1) + count // 2) // np.maximum(count, 1), 128)[:, None]
    own = px.reshape(H // 4, 4, W // 4, 4).swapaxes(1, 2).reshape(-1, 16)
    block = row4 * (W // 4) + col4
    r = (own[block] - found[block, mode]).reshape(-1, 4, 4)
    return row4, col4, mode, np.abs(r).sum(axis=(1, 2)), K.satd_atoms(r)[:, 0, 0]


def least_modes(px: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row4, col4, and the least SAD and SATD of all blocks of a frame, whichever modes give them."""
    row4, col4, mode, sad, satd = frame_modes(px, weights)
    # The modes of a block follow each other.
    first = np.flatnonzero(np.diff(row4 * (W // 4) + col4, prepend=-1))
    return row4[first], col4[first], np.minimum.reduceat(sad, first), np.minimum.reduceat(satd, first)


def intra4_frame(spark, d):
    """SAD and SATD of the allowed modes of each 4x4 block of the frames."""
    weights = _weights()

    def kernel(f, px):
        return list(zip(repeat(f), *(c.tolist() for c in frame_modes(px, weights))))

    return by_frame(A.frames(spark, d), kernel, ["frame_idx", "px"], "frame_idx long, row4 int, col4 int, mode int, sad int, satd int")


_B = f"SELECT f, r, c, 4 * r AS gy, 4 * c AS gx, r > 0 AND CASE WHEN c % 4 = 3 THEN r % 4 = 0 AND c // 4 + 1 < {W // 16} WHEN r % 4 = 0 THEN true ELSE {D._ORDER}[4 * (r % 4 - 1) + c % 4 + 2] < {D._ORDER}[4 * (r % 4) + c % 4 + 1] END AS right_ok FROM (SELECT DISTINCT vec_id // 24 AS f FROM embeddings), (SELECT CAST(unnest(range({H // 4})) AS INT) AS r), (SELECT CAST(unnest(range({W // 4})) AS INT) AS c)"
_NEAR = {"Q": (-1, -1), **{f"T{k}": (k, -1) for k in range(8)}, **{f"L{k}": (-1, k) for k in range(4)}}
_JOINS = " ".join(f"LEFT JOIN p {n.lower()} ON {n.lower()}.frame_idx = b.f AND {n.lower()}.x = b.gx + {dx} AND {n.lower()}.y = b.gy + {dy}" for n, (dx, dy) in _NEAR.items())
_S = "[" + ", ".join(["coalesce(q.v, t0.v)", *(f"t{k}.v" for k in range(4)), *(f"CASE WHEN right_ok THEN t{k}.v ELSE t3.v END" for k in range(4, 8)), *(f"l{k}.v" for k in range(4))]) + "]"


def _predicted_sql(mode: int) -> str:
    if mode == 2:
        return "list_transform(range(16), lambda i: dc)"
    out = []
    for y in range(4):
        for x in range(4):
            taps, shift = R._taps(mode, x, y)
            out.append(f"({' + '.join(f'{w} * s[{NAMES.index(n) + 1}]' for n, w in taps.items())} + {(1 << shift) >> 1}) >> {shift}")
    return "[" + ", ".join(out) + "]"


_OK = "CASE WHEN mode IN (1, 8, 4, 5, 6) AND c = 0 OR mode IN (0, 3, 7, 4, 5, 6) AND r = 0 THEN false WHEN mode IN (1, 8) THEN r >= 4 AND (c >= 4 OR NOT (r % 4 = 0 AND c % 4 = 2 OR r % 4 = 2 AND c % 4 IN (0, 2))) WHEN mode = 2 THEN true ELSE r >= 4 OR NOT (r % 4 = 1 AND c % 4 <= 1) END"
FRAME_SQL = f"""WITH p AS MATERIALIZED ({A.planes_sql()}), n AS (SELECT f, r, c, {_S} AS s, CASE WHEN r = 0 AND c = 0 THEN 128 WHEN r = 0 THEN (l0.v + l1.v + l2.v + l3.v + 2) // 4 WHEN c = 0 THEN (t0.v + t1.v + t2.v + t3.v + 2) // 4 ELSE (t0.v + t1.v + t2.v + t3.v + l0.v + l1.v + l2.v + l3.v + 4) // 8 END AS dc FROM ({_B}) b {_JOINS}),
o AS (SELECT frame_idx, y // 4 AS r, x // 4 AS c, list(v ORDER BY y, x) AS src FROM p GROUP BY ALL),
m AS (SELECT n.f, n.r, n.c, src, unnest(range(9)) AS mode, unnest([{', '.join(_predicted_sql(k) for k in range(9))}]) AS pred FROM n JOIN o ON o.frame_idx = n.f AND o.r = n.r AND o.c = n.c)
SELECT f AS frame_idx, CAST(r AS INT) AS row4, CAST(c AS INT) AS col4, CAST(mode AS INT) AS mode, CAST(list_sum(list_transform(res, lambda v: abs(v))) AS INT) AS sad, CAST((list_sum(list_transform({M.HAD}, lambda v: abs(v))) + 1)::BIGINT >> 1 AS INT) AS satd
FROM (SELECT *, list_transform(range(16), lambda i: src[i + 1] - pred[i + 1]) AS res FROM m WHERE {_OK})"""


def intra4_estimate(spark, d):
    """What intra 4x4 would cost a macroblock: the least SATD of each block, summed; and whether all could be predicted without error."""
    weights = _weights()

    def kernel(f, px):
        return list(zip(repeat(f), *(c.tolist() for c in least_modes(px, weights))))

    b = by_frame(A.frames(spark, d), kernel, ["frame_idx", "px"], "frame_idx long, row4 int, col4 int, sad int, satd int")
    g = b.groupBy("frame_idx", F.expr("cast(row4 div 4 as int)").alias("row"), F.expr("cast(col4 div 4 as int)").alias("col"))
    return g.agg(F.sum("satd").alias("satd"), (F.sum("sad") == 0).alias("exact"))


ESTIMATE_SQL = f"SELECT frame_idx, CAST(row4 // 4 AS INT) AS row, CAST(col4 // 4 AS INT) AS col, CAST(sum(satd) AS BIGINT) AS satd, sum(sad) = 0 AS exact FROM (SELECT frame_idx, row4, col4, min(satd) AS satd, min(sad) AS sad FROM ({FRAME_SQL}) GROUP BY ALL) GROUP BY 1, 2, 3"

CATALOG = {
    "q_intra4_frame": (intra4_frame, FRAME_SQL),
    "q_intra4_estimate": (intra4_estimate, ESTIMATE_SQL),
}
