"""Search, interpolation, reconstruction and in-loop filtering of whole frames.

A row is a frame with its predecessor; frames meet their predecessors by an equi-join on the frame number, and nothing
else moves. The kernels run over Arrow batches of such rows, so memory is a batch of frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockflow.functions import motion as K
from blockflow.functions import tables as T
from blockflow.functions.folds import dealt
from blockflow.operators import bits as S
from blockflow.operators import entropy as E
from blockflow.operators import filters as P
from blockflow.sources import adapters as A

W, H = A.PLANE_WIDTH, A.PLANE_HEIGHT
LAMBDA, REACH = 4, 8
#: Rows that the kernels gather, and samples of the frames they are of, before they go back to Spark; a frame's own may be more.
ROWS, SAMPLES = 4096, 1 << 20


def pairs(spark, d) -> DataFrame:
    """frame_idx, cur, ref, width, height: a plane (bytes in raster order) and the one before. A plane is made once and goes to both frames that read it."""
    none = F.lit(None).cast("binary")
    own = F.struct("frame_idx", F.col("px").alias("cur"), none.alias("ref"))
    next_ = F.struct((F.col("frame_idx") + 1).alias("frame_idx"), none.alias("cur"), F.col("px").alias("ref"))
    p = A.frames(spark, d).select("width", "height", F.explode(F.array(own, next_)).alias("p")).select("p.*", "width", "height")
    p = dealt(p, "frame_idx").groupBy("frame_idx").agg(*(F.max(c).alias(c) for c in ("cur", "ref", "width", "height")))
    return p.where("cur IS NOT NULL AND ref IS NOT NULL")


def picture_pairs(spark, d) -> DataFrame:
    """The same of the pictures that the vectors make."""
    p = A.pictures(spark, d).select("frame_idx", "width", "height", F.col("y").alias("cur"))
    return p.join(p.select((F.col("frame_idx") + 1).alias("frame_idx"), F.col("cur").alias("ref")), "frame_idx")


def by_frame(rows: DataFrame, kernel: Callable[..., list[tuple]], names: list[str], schema: str) -> DataFrame:
    """Rows that the kernel makes of each row's columns `names`; binary columns reach it as planes of the row's width and height. Rows are dealt
    by the first of `names`: a frame is few bytes and much work."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}
    out = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    gathered = lambda made: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, samples = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                w, h, *row = (batch.column(n)[k].as_py() for n in ("width", "height", *names))
                made += kernel(*(np.frombuffer(v, np.uint8).reshape(h, w) if isinstance(v, bytes | bytearray) else v for v in row))
                samples += w * h
                if made and (len(made) >= ROWS or samples >= SAMPLES):
                    yield gathered(made)
                    made, samples = [], 0
        if made:
            yield gathered(made)

    return dealt(rows.select("width", "height", *names), names[0]).mapInArrow(run, schema)


def _blocks(cur: np.ndarray, ref: np.ndarray, satd: bool = True, quarters: bool = True) -> Iterator[tuple[int, int, K.Block]]:
    """Every macroblock with its place. quarters: the reference is interpolated once for all of them; else only where one asks."""
    p = K.padded(ref)
    q = K.quarters(p) if quarters else None
    for y in range(0, cur.shape[0], 16):
        for x in range(0, cur.shape[1], 16):
            yield x // 16, y // 16, K.Block(cur[y : y + 16, x : x + 16], p, x + K.HALO, y + K.HALO, REACH, satd, q)


def quarter_samples(spark, d):
    """Every plane at its sixteen quarter positions."""

    def kernel(f, px):
        h, w = px.shape
        q = K.quarter(K.padded(px), K.HALO, K.HALO, w, h)
        return [(f, fx, fy, y, q[fy, fx, y].tolist()) for fy in range(4) for fx in range(4) for y in range(h)]

    return by_frame(A.frames(spark, d), kernel, ["frame_idx", "px"], "frame_idx long, fx int, fy int, y int, line array<int>")


def _tap(of: str, w: str) -> str:
    """A six-tap sum along a window of samples."""
    return f"lag({of}, 2) OVER {w} + lead({of}, 3) OVER {w} - 5 * (lag({of}, 1) OVER {w} + lead({of}, 2) OVER {w}) + 20 * ({of} + lead({of}, 1) OVER {w})"


_ALONG = "WINDOW wx AS (PARTITION BY f, y ORDER BY x), wy AS (PARTITION BY f, x ORDER BY y)"
QUARTER_SQL = f"""WITH e AS (SELECT g.f, g.x, g.y, p.v::BIGINT AS v FROM (SELECT f, x, CAST(unnest(range(-3, {H + 4})) AS INT) AS y FROM (SELECT f, CAST(unnest(range(-3, {W + 4})) AS INT) AS x FROM (SELECT DISTINCT vec_id // 24 AS f FROM embeddings))) g JOIN ({A.planes_sql()}) p ON p.frame_idx = g.f AND p.x = greatest(0, least({W - 1}, g.x)) AND p.y = greatest(0, least({H - 1}, g.y))),
a AS (SELECT *, {_tap('v', 'wx')} AS ax, {_tap('v', 'wy')} AS ay FROM e {_ALONG}),
j AS (SELECT f, x, y, v, greatest(0, least(255, (ax + 16) >> 5)) AS h, greatest(0, least(255, (ay + 16) >> 5)) AS w, greatest(0, least(255, ({_tap('ax', 'wy')} + 512) >> 10)) AS j FROM a {_ALONG}),
s AS (SELECT f, x, y, v AS g, h, w, j, lead(v) OVER wx AS gr, lead(v) OVER wy AS gb, lead(h) OVER wy AS hb, lead(w) OVER wx AS wr FROM j {_ALONG})
SELECT f AS frame_idx, CAST(k % 4 AS INT) AS fx, CAST(k // 4 AS INT) AS fy, y, list(CAST(v AS INT) ORDER BY x) AS line FROM (SELECT f, x, y, unnest(range(16)) AS k, unnest([g, (g + h + 1) >> 1, h, (gr + h + 1) >> 1, (g + w + 1) >> 1, (h + w + 1) >> 1, (h + j + 1) >> 1, (h + wr + 1) >> 1, w, (w + j + 1) >> 1, j, (j + wr + 1) >> 1, (gb + w + 1) >> 1, (w + hb + 1) >> 1, (j + hb + 1) >> 1, (wr + hb + 1) >> 1]) AS v FROM s WHERE x BETWEEN 0 AND {W - 1} AND y BETWEEN 0 AND {H - 1}) GROUP BY f, k, y"""


def motion_full(spark, d):
    """Full search by SAD within 4 samples: smallest score (SAD and vector cost), then SAD, then |x| + |y|, x, y."""

    def kernel(f, cur, ref):
        found = [(bx, by, b.full("16x16", (0, 0), 4, LAMBDA)) for bx, by, b in _blocks(cur, ref, satd=False, quarters=False)]
        return [(f, by, bx, mv[0] // 4, mv[1] // 4, s, s + K.vector_cost(LAMBDA, mv[0] // 4, mv[1] // 4)) for bx, by, (s, mv) in found]

    return by_frame(pairs(spark, d), kernel, ["frame_idx", "cur", "ref"], "frame_idx long, br int, bc int, dx int, dy int, sad long, score long")


_SADS = f"""SELECT c.frame_idx, c.y // {{n}} AS br, c.x // {{n}} AS bc, dx, dy, CAST(sum(abs(c.v - r.v)) AS BIGINT) AS sad FROM ({A.planes_sql()}) c,
  (SELECT unnest(range(-4, 5)) AS dx), (SELECT unnest(range(-4, 5)) AS dy) JOIN ({A.planes_sql()}) r ON r.frame_idx = c.frame_idx - 1 AND r.x = greatest(0, least({W - 1}, c.x + dx)) AND r.y = greatest(0, least({H - 1}, c.y + dy)) GROUP BY ALL"""
_COST_SQL = f"(({LAMBDA} * (CAST(round_even(256 * log2(abs(dx) + 1.0::DOUBLE), 0) AS BIGINT) + CAST(round_even(256 * log2(abs(dy) + 1.0::DOUBLE), 0) AS BIGINT))) >> 8)"
FULL_SQL = f"""SELECT frame_idx, br, bc, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, sad, score FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, br, bc ORDER BY score, sad, abs(dx) + abs(dy), dx, dy) AS k FROM (SELECT *, sad + {_COST_SQL} AS score FROM ({_SADS.format(n=16)}))) WHERE k = 1"""


#: The range of a full search in whole samples.
RANGE = 32


def motion_rings(spark, d):
    """Full search by SAD within 32 samples, in rings that end when no vector of a further one can win; and how many of the 4,225 offsets were scored."""

    def kernel(f, cur, ref):
        halo = RANGE + 16
        p, out = K.padded(ref, halo), []
        for y in range(0, cur.shape[0], 16):
            for x in range(0, cur.shape[1], 16):
                s, mv, n = K.rings(cur[y : y + 16, x : x + 16].astype(np.int32), p, x + halo, y + halo, RANGE, LAMBDA)
                out.append((f, y // 16, x // 16, mv[0] // 4, mv[1] // 4, s, n))
        return out

    return by_frame(pairs(spark, d), kernel, ["frame_idx", "cur", "ref"], "frame_idx long, br int, bc int, dx int, dy int, sad long, scored int")


def motion_field(spark, d):
    """The fast search on pictures of the vectors, with the vector found at the same place of the frame before as temporal candidate. Frames are folded in order within segments of
    FIELD frames, whose first has no candidate, as a picture that begins a group has none."""
    from collections import namedtuple

    out = pa.schema([("frame_idx", pa.int64()), ("br", pa.int32()), ("bc", pa.int32()), ("seed_x", pa.int32()), ("seed_y", pa.int32()), ("part", pa.int32()), ("total", pa.int64()), ("vectors", pa.list_(pa.list_(pa.int32())))])
    Found = namedtuple("Found", out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, field = None, {}
        for b in batches:
            made = []
            for f, w, h, cur, ref in zip(*(b.column(n).to_pylist() for n in ("frame_idx", "width", "height", "cur", "ref"))):
                if last is None or f != last + 1 or f % FIELD == 0:
                    field = {}
                cur, ref = (np.frombuffer(p, np.uint8).reshape(h, w) for p in (cur, ref))
                found = {}
                for bx, by, block in _blocks(cur, ref):
                    seed = field.get((bx, by), (0, 0))
                    part, total, vectors = K.search(block, LAMBDA, REACH, temporal=seed)
                    found[bx, by] = tuple(vectors[0])
                    made.append(Found(f, by, bx, *seed, part, total, [list(v) for v in vectors]))
                last, field = f, found
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), out)], schema=out)

    rows = picture_pairs(spark, d).withColumn("segment", F.expr(f"frame_idx div {FIELD}"))
    rows = dealt(rows, "segment").sortWithinPartitions("frame_idx")
    return rows.select("frame_idx", "width", "height", "cur", "ref").mapInArrow(run, "frame_idx long, br int, bc int, seed_x int, seed_y int, part int, total long, vectors array<array<int>>")


#: Frames of a segment of the motion field.
FIELD = 64


def motion_partitions(spark, d):
    """One scan scores the sixteen 4x4 atoms by SATD and sums them into nine shapes; the partition of lowest total wins, ties to the first."""

    def kernel(f, cur, ref):
        out = []
        for bx, by, b in _blocks(cur, ref, quarters=False):
            totals = [sum(b.full(s, (0, 0), 2, LAMBDA)[0] for s in shapes) for shapes in K.PARTS]
            part = int(np.argmin(totals))
            out.append((f, by, bx, part, totals[part]))
        return out

    return by_frame(pairs(spark, d), kernel, ["frame_idx", "cur", "ref"], "frame_idx long, br int, bc int, part int, total long")


_SHAPE_ROWS = ", ".join(f"({part}, {n}, {x // 4 + 4 * (y // 4)}, {w // 4}, {h // 4})" for part, shapes in enumerate(K.PARTS) for n, s in enumerate(shapes) for x, y, w, h in [K.SHAPES[s]])


def _atoms_sql() -> str:
    """SATD of each 4x4 atom at each offset, by lists of residuals."""
    from blockflow.operators.blockmath import HAD

    return f"""SELECT frame_idx, ar, ac, dx, dy, (list_sum(list_transform({HAD}, lambda v: abs(v))) + 1)::BIGINT >> 1 AS satd FROM (SELECT c.frame_idx, c.y // 4 AS ar, c.x // 4 AS ac, dx, dy, list(c.v - r.v ORDER BY c.y, c.x) AS res FROM ({A.planes_sql()}) c,
      (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) JOIN ({A.planes_sql()}) r ON r.frame_idx = c.frame_idx - 1 AND r.x = greatest(0, least({W - 1}, c.x + dx)) AND r.y = greatest(0, least({H - 1}, c.y + dy)) GROUP BY ALL)"""


PARTITIONS_SQL = f"""WITH a AS MATERIALIZED (SELECT *, ar // 4 AS br, ac // 4 AS bc FROM ({_atoms_sql()})),
s AS (SELECT frame_idx, br, bc, part, n, dx, dy, CAST(sum(satd) AS BIGINT) AS s FROM a JOIN (VALUES {_SHAPE_ROWS}) t(part, n, first, w, h) ON ac % 4 BETWEEN first % 4 AND first % 4 + w - 1 AND ar % 4 BETWEEN first // 4 AND first // 4 + h - 1 GROUP BY ALL),
b AS (SELECT frame_idx, br, bc, part, n, s FROM s QUALIFY row_number() OVER (PARTITION BY frame_idx, br, bc, part, n ORDER BY s + {_COST_SQL}, s, abs(dx) + abs(dy), dx, dy) = 1),
t AS (SELECT frame_idx, br, bc, part, CAST(sum(s) AS BIGINT) AS total FROM b GROUP BY ALL)
SELECT frame_idx, CAST(br AS INT) AS br, CAST(bc AS INT) AS bc, CAST(min_by(part, total * 4 + part) AS INT) AS part, min(total) AS total FROM t GROUP BY frame_idx, br, bc"""

_FOUND = "frame_idx long, br int, bc int, part int, total long, vectors array<array<int>>"


def motion_search(spark, d, satd: bool = True):
    """The fast search of a macroblock: hexagon and diamond steps, exhaustive fallback, quarter-sample refinement, smaller shapes. The frame
    number gives the temporal candidate."""

    def kernel(f, cur, ref):
        return [(f, by, bx, part, total, [list(v) for v in vectors]) for bx, by, b in _blocks(cur, ref, satd) for part, total, vectors in [K.search(b, LAMBDA, REACH, temporal=(12, 4) if f % 2 else None)]]

    return by_frame(pairs(spark, d), kernel, ["frame_idx", "cur", "ref"], _FOUND)


def motion_search_sad(spark, d):
    return motion_search(spark, d, satd=False)


def inter_recon(spark, d):
    """Luma and chroma predictions of every macroblock by the found partitions: their sums and squared errors. Chroma is the plane at half size, and its complement."""

    def kernel(f, cur, ref):
        half = lambda p: (p[::2, ::2].astype(np.int32) + p[::2, 1::2] + p[1::2, ::2] + p[1::2, 1::2] + 2) >> 2
        u = half(ref)
        planes = K.padded(ref), K.padded(u, K.HALO // 2), K.padded(255 - u, K.HALO // 2)
        cu = half(cur)
        out = []
        for bx, by, b in _blocks(cur, ref):
            part, _, vectors = K.search(b, LAMBDA, REACH)
            y, pu, pv = K.predicted(planes, 16 * bx, 16 * by, part, vectors, quarters=b.quarters)
            own = cu[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8]
            out.append((f, by, bx, part, int(y.sum()), int(((b.cur - y) ** 2).sum()), int(((own - pu) ** 2).sum() + ((255 - own - pv) ** 2).sum())))
        return out

    return by_frame(pairs(spark, d), kernel, ["frame_idx", "cur", "ref"], "frame_idx long, br int, bc int, part int, luma_sum long, sse_y long, sse_uv long")


# Strengths of all edges of 4x4 blocks: motion by 8x8 quadrant, coefficients by block.
_STRENGTH = "CASE WHEN {outer} AND (intra OR n_intra) THEN 4 WHEN intra THEN 3 WHEN n > 0 OR n_n > 0 THEN 2 WHEN ref <> n_ref OR abs(mvx - n_mvx) >= 4 OR abs(mvy - n_mvy) >= 4 THEN 1 ELSE 0 END"


def _edges(spark, d) -> DataFrame:
    """4x4 blocks with coefficient count, the motion of their quadrant, kind and QP of their macroblock."""
    q = A.blocks(spark, d).select("vec_id", (F.get("px", F.lit(0)) - 128).alias("mvx"), (F.get("px", F.lit(1)) - 128).alias("mvy"), (F.get("px", F.lit(2)) % 2).alias("ref"))
    m = S._field(spark, d).select("mb_id", "intra", F.col("qp").alias("mb_qp"))
    c = E.counted(spark, d).select("frame_idx", "mb_idx", "row4", "col4", "vec_id", "n").join(q, "vec_id")
    return c.withColumn("mb_id", F.expr("vec_id div 4")).join(m, "mb_id")


def strengths(spark, d):
    """Strength and mean QP of the left and the upper edge of each 4x4 block; whether it lies inside the slice."""
    c = _edges(spark, d)
    out = []
    for kind, line, along in (("left", "row4", "col4"), ("upper", "col4", "row4")):
        w = Window.partitionBy("frame_idx", line).orderBy(along)
        e = c.select("*", *[F.lag(x).over(w).alias(f"n_{x}") for x in ("intra", "n", "ref", "mvx", "mvy", "mb_qp")]).where(f"{along} > 0")
        outer = f"{along} % 4 = 0"
        qp = f"CASE WHEN {outer} THEN shiftright(mb_qp + n_mb_qp + 1, 1) ELSE mb_qp END AS qp"
        inside = "true" if kind == "left" else "NOT (row4 % 4 = 0 AND frame_idx % 2 = 1)"
        out.append(e.selectExpr("frame_idx", "row4", "col4", f"'{kind}' AS edge", f"{_STRENGTH.format(outer=outer)} AS bs", qp, f"{inside} AS in_slice"))
    return out[0].union(out[1])


_EDGES_SQL = f"SELECT c.frame_idx, c.row4, c.col4, c.n, px[1] - 128 AS mvx, px[2] - 128 AS mvy, px[3] % 2 AS ref, m.intra, m.qp AS mb_qp FROM ({E.COUNTED_SQL}) c JOIN ({A.BLOCKS_SQL}) q ON q.vec_id = c.vec_id JOIN ({S.FIELD_SQL}) m ON m.mb_id = c.vec_id // 4"


def _edge_sql(kind: str, dr: int, dc: int, along: str, inside: str) -> str:
    return f"""SELECT a.frame_idx, a.row4, a.col4, '{kind}' AS edge, CASE WHEN a.{along} % 4 = 0 AND (a.intra OR b.intra) THEN 4 WHEN a.intra THEN 3 WHEN a.n + b.n > 0 THEN 2 WHEN a.ref = b.ref AND abs(a.mvx - b.mvx) < 4 AND abs(a.mvy - b.mvy) < 4 THEN 0 ELSE 1 END AS bs,
  CASE WHEN a.{along} % 4 = 0 THEN (a.mb_qp + b.mb_qp + 1) >> 1 ELSE a.mb_qp END AS qp, {inside} AS in_slice FROM e a JOIN e b ON b.frame_idx = a.frame_idx AND b.row4 = a.row4 - {dr} AND b.col4 = a.col4 - {dc}"""


STRENGTH_SQL = f"WITH e AS MATERIALIZED ({_EDGES_SQL}) {_edge_sql('left', 0, 1, 'col4', 'true')} UNION ALL {_edge_sql('upper', 1, 0, 'row4', 'NOT (a.row4 % 4 = 0 AND a.frame_idx % 2 = 1)')}"


def active_edges(spark, d):
    """Macroblocks with an edge to filter, by direction: all others are left out before any sample is read."""
    s = strengths(spark, d).where("in_slice")
    g = s.groupBy("frame_idx", F.expr("cast(row4 div 4 as int)").alias("row"), F.expr("cast(col4 div 4 as int)").alias("col"))
    return g.agg(F.bool_or((F.col("edge") == "left") & (F.col("bs") > 0)).alias("vertical"), F.bool_or((F.col("edge") == "upper") & (F.col("bs") > 0)).alias("horizontal"))


ACTIVE_SQL = f"SELECT frame_idx, CAST(row4 // 4 AS INT) AS row, CAST(col4 // 4 AS INT) AS col, bool_or(edge = 'left' AND bs > 0) AS vertical, bool_or(edge = 'upper' AND bs > 0) AS horizontal FROM ({STRENGTH_SQL}) WHERE in_slice GROUP BY 1, 2, 3"


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thresholds alpha and beta by QP, clipping values by QP and strength."""
    return np.array(P.ALPHA), np.array(P.BETA), np.array(P.TC0)


def deblocked(spark, d):
    """Whole pictures after the in-loop filter: a sum and a digest of each plane. Chroma is the luma plane at half size, and its complement."""
    s = strengths(spark, d).where("in_slice")
    cell = lambda e: F.array_sort(F.collect_list(F.when(F.col("edge") == e, F.struct("row4", "col4", "bs"))))
    s = s.groupBy("frame_idx").agg(cell("left").alias("left"), cell("upper").alias("upper"))  # the edges of one picture
    q = S._field(spark, d).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("mb_idx", "qp"))).alias("qps")).where(F.size("qps") == A.MBS_PER_FRAME)  # whole frames
    rows = A.frames(spark, d).join(s, "frame_idx").join(q, "frame_idx")
    chroma, own = np.array([T.chroma_qp(k) for k in range(52)]), tables()

    def kernel(f, px, left, upper, qps):
        from hashlib import md5

        rows, cols = px.shape
        v, h = (np.zeros((rows // 4, cols // 4), np.int64) for _ in range(2))
        for to, cells in ((v, left), (h, upper)):
            for c in cells:
                to[c["row4"], c["col4"]] = c["bs"]
        qp = np.array([x["qp"] for x in qps]).reshape(rows // 16, cols // 16)
        u = (px[::2, ::2].astype(np.int32) + px[::2, 1::2] + px[1::2, ::2] + px[1::2, 1::2] + 2) >> 2
        out = K.filtered((px, u, 255 - u), v, h, qp, chroma[qp], own)
        return [(f, name, int(p.sum()), int((p != before).sum()), md5(p.astype(np.uint8).tobytes()).hexdigest()) for name, p, before in zip("yuv", out, (px, u, 255 - u))]

    return by_frame(rows, kernel, ["frame_idx", "px", "left", "upper", "qps"], "frame_idx long, plane string, total long, changed long, digest string")


CATALOG = {
    "q_quarter_samples": (quarter_samples, QUARTER_SQL),
    "q_motion_full": (motion_full, FULL_SQL),
    "q_motion_rings": (motion_rings, None),
    "q_motion_field": (motion_field, None),
    "q_motion_partitions": (motion_partitions, PARTITIONS_SQL),
    "q_motion_search": (motion_search, None),
    "q_motion_search_sad": (motion_search_sad, None),
    "q_inter_recon": (inter_recon, None),
    "q_boundary_strength": (strengths, STRENGTH_SQL),
    "q_active_edges": (active_edges, ACTIVE_SQL),
    "q_deblock_picture": (deblocked, None),
}
