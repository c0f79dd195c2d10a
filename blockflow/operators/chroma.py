"""Blocks encoded and rebuilt in one step: chroma 8x8 with its chained DC, and 4x4 luma with prediction.

A block is predicted by its successor; nothing but the pairing shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import encode as E
from blockflow.functions import tables as T
from blockflow.operators import blockmath as M
from blockflow.operators import chains as C
from blockflow.sources import adapters as A

_CHROMA_QP = [T.chroma_qp(q) for q in range(52)]
_H2 = np.array([[1, 1], [1, -1]])


def prepared(own: np.ndarray, pred: np.ndarray, qp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chroma blocks (n, 8, 8) against their predictions at luma QPs (n): dc (n, 2, 2) levels, half-even and within 2048, ac (n, 2, 2, 4, 4)
    levels whose first is 0, whether a block has any of them, and rebuilt samples (n, 8, 8)."""
    parts = lambda x: x.reshape(-1, 2, 4, 2, 4).swapaxes(2, 3)
    cqp = np.array(_CHROMA_QP)[qp]
    wide = cqp[:, None, None, None, None]
    mul = (np.array(C.DC_SCALE)[cqp % 6] << (cqp // 6 + 2))[:, None, None]
    coef = E._CORE @ parts(own - pred) @ E._CORE.T
    dc = np.clip(np.rint(_H2 @ (2 * coef[..., 0, 0]) @ _H2 * (64.0 / mul)).astype(np.int64), -2048, 2048)
    shift = 15 + wide // 6
    ac = np.sign(coef) * ((np.abs(coef) * E.MF[cqp % 6][:, None, None] + (1 << shift - 1)) >> shift)
    ac[..., 0, 0] = 0
    deq = (ac * E.NORM[cqp % 6][:, None, None]) << wide // 6
    deq[..., 0, 0] = 2 * ((_H2 @ dc @ _H2 * mul) >> 8)
    rebuilt = np.clip(parts(pred) + E._inverse(deq), 0, 255)
    return dc, ac, ac.any(axis=(1, 2, 3, 4)), rebuilt


def chroma_prepare(spark, d):
    """Levels in scan order, AC flag and rebuilt samples of chroma blocks, without the refinement of the DC levels. A batch of blocks is one array."""
    kind = "vec_id long, dc array<int>, ac array<array<int>>, any_ac boolean, rebuilt array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, pred = (b.column(c).flatten().to_numpy().astype(np.int64).reshape(-1, 8, 8) for c in "ab")
            dc, ac, any_ac, rebuilt = prepared(own, pred, b.column("vec_id").to_numpy() % 52)
            scan = ac.reshape(-1, 4, 16)[:, :, E.ZIGZAG]
            lists = [pa.array(x.tolist(), t) for x, t in ((dc.reshape(-1, 4), pa.list_(pa.int32())), (scan, pa.list_(pa.list_(pa.int32()))), (rebuilt.reshape(-1, 4, 16), pa.list_(pa.list_(pa.int32()))))]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists[0], lists[1], pa.array(any_ac), lists[2]], ["vec_id", "dc", "ac", "any_ac", "rebuilt"])

    return A.pairs(spark, d).select("vec_id", "a", "b").mapInArrow(run, kind)


_AT = "((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1"
_CLASS = [T.position_class(k) for k in range(16)]
# A row a 4x4 block; the four of a block meet again by its id.
CHROMA_SQL = f"""WITH r AS (SELECT vec_id, k, cqp, list_transform(range(16), lambda i: a[{_AT}] - b[{_AT}]) AS res, list_transform(range(16), lambda i: b[{_AT}]) AS pred
  FROM (SELECT *, {_CHROMA_QP}[CAST(vec_id % 52 + 1 AS INT)] AS cqp, unnest(range(4)) AS k FROM ({A.PAIRS_SQL}))),
c AS (SELECT *, {C.DC_SCALE}[CAST(cqp % 6 + 1 AS INT)] * (1 << CAST(cqp // 6 + 2 AS INT)) AS mul, {M.DCT} AS coef FROM r),
q AS (SELECT vec_id, k, cqp, mul, pred, 2 * coef[1] AS dc, list_transform(range(16), lambda i: CASE WHEN i = 0 THEN 0 ELSE CAST(sign(coef[i + 1]) * ((abs(coef[i + 1])::BIGINT * {[list(m) for m in T.QUANT_MF]}[CAST(cqp % 6 + 1 AS INT)][{_CLASS}[i + 1] + 1] + (1::BIGINT << CAST(14 + cqp // 6 AS INT))) >> CAST(15 + cqp // 6 AS INT)) AS INT) END) AS ac FROM c),
g AS (SELECT vec_id, list_transform({M._H2}, lambda h: CAST(greatest(-2048, least(2048, round_even(list_sum(list_transform(range(4), lambda j: h[j + 1] * d[j + 1])) * (64.0::DOUBLE / mul), 0))) AS INT)) AS dc FROM (SELECT vec_id, any_value(mul) AS mul, list(dc ORDER BY k) AS d FROM q GROUP BY vec_id)),
f AS (SELECT q.vec_id, k, pred, ac, g.dc, list_transform(range(16), lambda i: CASE WHEN i = 0 THEN 2 * CAST((list_sum(list_transform(range(4), lambda j: {M._H2}[k + 1][j + 1] * g.dc[j + 1]))::BIGINT * mul) >> 8 AS INT)
  ELSE ac[i + 1] * {[list(m) for m in T.NORM_ADJUST]}[CAST(cqp % 6 + 1 AS INT)][{_CLASS}[i + 1] + 1] * (1 << CAST(cqp // 6 AS INT)) END) AS deq FROM q JOIN g ON g.vec_id = q.vec_id),
s AS (SELECT *, {M._inv('t', 'u', 4, 1)} FROM (SELECT *, {M._inv('deq', 't', 1, 4)} FROM f))
SELECT vec_id, any_value(dc) AS dc, list(list_transform({list(T.ZIGZAG)}, lambda z: ac[z + 1]) ORDER BY k) AS ac, bool_or(len(list_filter(ac, lambda v: v <> 0)) > 0) AS any_ac,
  list(list_transform(range(16), lambda n: CAST(greatest(0, least(255, pred[n + 1] + ((u[(n % 4) * 4 + n // 4 + 1] + 32) >> 6))) AS INT)) ORDER BY k) AS rebuilt FROM s GROUP BY vec_id"""


def residual_predicted(spark, d):
    """4x4 blocks encoded against their prediction and rebuilt on it: level count, samples within 0 to 255, squared error against the source."""
    r = A.pairs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(B.split4(F.col("a"), 8).alias("a"), B.split4(F.col("b"), 8).alias("b"))).alias("blk", "x"))
    r = r.select("vec_id", "blk", "x.a", "x.b", ((F.col("vec_id") * 4 + F.col("blk")) % 52).cast("int").alias("qp"))
    r = r.withColumn("level", B.quant4x4(B.dct4x4(B.residual(F.col("a"), F.col("b"))), F.col("qp")))
    r = r.withColumn("rebuilt", F.zip_with("b", B.idct4x4(B.dequant4x4(F.col("level"), F.col("qp"))), lambda p, v: B.clamp(p + v, 0, 255)))
    return r.select("vec_id", "blk", F.size(F.filter("level", lambda v: v != 0)).alias("nnz"), "rebuilt", B.ssd(F.col("a"), F.col("rebuilt")).alias("sse"))


PREDICTED_SQL = f"""SELECT vec_id, blk, len(list_filter(level, lambda v: v <> 0))::INT AS nnz, rebuilt, CAST(list_sum(list_transform(range(16), lambda i: (a[i + 1] - rebuilt[i + 1]) * (a[i + 1] - rebuilt[i + 1]))) AS INT) AS sse
FROM (SELECT vec_id, blk, level, a, list_transform(range(16), lambda i: CAST(greatest(0, least(255, a[i + 1] - res[i + 1] + rec[i + 1])) AS INT)) AS rebuilt
FROM (SELECT r.vec_id, r.blk, level, res, rec, list_transform(range(16), lambda i: p.px[((r.blk // 2) * 4 + i // 4) * 8 + (r.blk % 2) * 4 + i % 4 + 1]) AS a FROM ({M.REC_SQL}) r JOIN ({A.BLOCKS_SQL}) p ON p.vec_id = r.vec_id))"""

CATALOG = {
    "q_chroma_prepare": (chroma_prepare, CHROMA_SQL),
    "q_residual_predicted": (residual_predicted, PREDICTED_SQL),
}
