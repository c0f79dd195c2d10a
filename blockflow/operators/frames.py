"""Plane operators: padding, cropping, colour conversion, interpolation, intra 4x4 prediction.

Stencils are windows along a line, samples that repeat are exploded; argmins are min_by over a total order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.sources import adapters as A

W, H = A.PLANE_WIDTH, A.PLANE_HEIGHT


def _grid_sql(w, h, x0=0, y0=0):
    return f"(SELECT DISTINCT vec_id // 24 AS frame_idx FROM embeddings), (SELECT CAST(unnest(range({y0}, {y0 + h})) AS INT) AS y), (SELECT CAST(unnest(range({x0}, {x0 + w})) AS INT) AS x)"


def _spread(spark, d, w, h, to_w, to_h, x0=0, y0=0):
    """Planes as rectangles of to_w x to_h from (x0, y0) on: a sample goes to its own place, one at the edge also to those beyond. No join."""
    def places(c, n, first, last):
        start, stop = F.when(F.col(c) == 0, first).otherwise(F.col(c)), F.when(F.col(c) == n - 1, last).otherwise(F.col(c))
        return F.explode(F.sequence(start, stop)).alias(c)

    rows = A.planes(spark, d, w, h).select("frame_idx", places("y", h, y0, y0 + to_h - 1), "x", "v")
    return rows.select("frame_idx", "y", places("x", w, x0, x0 + to_w - 1), "v")


def pad_extend(spark, d):
    """20x12 planes to the next multiples of 16: last column and last row repeated."""
    return _spread(spark, d, 20, 12, 32, 16)


def halo(spark, d):
    """A border of 8 on all sides, clamped to the edge."""
    return _spread(spark, d, 20, 12, 20 + 16, 12 + 16, -8, -8)


def _pad_sql(w, h, grid):
    return f"SELECT g.frame_idx, g.y, g.x, s.v FROM (SELECT * FROM {grid}) g JOIN ({A.planes_sql(w, h)}) s ON s.frame_idx = g.frame_idx AND s.x = greatest(0, least({w - 1}, g.x)) AND s.y = greatest(0, least({h - 1}, g.y))"


def crop_flip(spark, d):
    """Display crop of 48x32 to 40x30, rows turned bottom up."""
    return A.planes(spark, d).where("x < 40 AND y < 30").select("frame_idx", (29 - F.col("y")).alias("y"), "x", "v")


def _rgb(spark, d):
    return A.planes(spark, d).select("frame_idx", "y", "x", F.col("v").alias("r"), ((F.col("v") * 3).bitwiseAND(255)).alias("g"), ((F.col("v") + F.col("x")).bitwiseAND(255)).alias("b"))


def rgb_to_luma(spark, d):
    return _rgb(spark, d).select("frame_idx", "y", "x", F.expr("16 + shiftright(66 * r + 129 * g + 25 * b + 128, 8)").alias("luma"))


def rgb_to_chroma(spark, d):
    """2x2 integer means, then studio-swing fixed point."""
    m = _rgb(spark, d).groupBy("frame_idx", F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx")).agg(*[F.expr(f"cast(sum({c}) div 4 as int)").alias(c) for c in "rgb"])
    return m.select("frame_idx", "cy", "cx", F.expr("128 + shiftright(-38 * r - 74 * g + 112 * b + 128, 8)").alias("u"), F.expr("128 + shiftright(112 * r - 94 * g - 18 * b + 128, 8)").alias("v"))


_RGB_SQL = f"SELECT frame_idx, y, x, v AS r, (v * 3) & 255 AS g, (v + x) & 255 AS b FROM ({A.planes_sql()})"
CHROMA_SQL = f"SELECT frame_idx, cy, cx, 128 + ((-38 * r - 74 * g + 112 * b + 128) >> 8) AS u, 128 + ((112 * r - 94 * g - 18 * b + 128) >> 8) AS v FROM (SELECT frame_idx, y // 2 AS cy, x // 2 AS cx, CAST(sum(r) // 4 AS INT) AS r, CAST(sum(g) // 4 AS INT) AS g, CAST(sum(b) // 4 AS INT) AS b FROM ({_RGB_SQL}) GROUP BY ALL)"


def yuyv_repack(spark, d):
    """An 8x8 block as 8 lines of packed Y U Y V: luma gathered, chroma averaged over line pairs with rounding."""
    px = F.col("px")
    pick = lambda a, r, k: F.transform(F.filter(F.transform(a, lambda v, i: F.when(i % k == r, v)), lambda v: v.isNotNull()), lambda v: v)
    both = lambda r: F.array(*[F.shiftright(px[16 * p + 4 * k + r] + px[16 * p + 8 + 4 * k + r] + 1, 1) for p in range(4) for k in range(2)])
    return A.blocks(spark, d).select("vec_id", pick(px, 0, 2).alias("luma"), both(1).alias("u"), both(3).alias("v"))


def uyvy_repack(spark, d):
    """The same of lines packed as U Y V Y."""
    px = F.col("px")
    both = lambda r: F.array(*[F.shiftright(px[16 * p + 4 * k + r] + px[16 * p + 8 + 4 * k + r] + 1, 1) for p in range(4) for k in range(2)])
    return A.blocks(spark, d).select("vec_id", F.filter("px", lambda v, i: i % 2 == 1).alias("luma"), both(0).alias("u"), both(2).alias("v"))


def _yuyv_sql(r):
    return f"list_transform(range(8), lambda i: (px[16 * (i // 2) + 4 * (i % 2) + {r} + 1] + px[16 * (i // 2) + 8 + 4 * (i % 2) + {r} + 1] + 1) >> 1)"


YUYV_SQL = f"SELECT vec_id, list_transform(range(32), lambda i: px[2 * i + 1]) AS luma, {_yuyv_sql(1)} AS u, {_yuyv_sql(3)} AS v FROM ({A.BLOCKS_SQL})"


def nv12_split(spark, d):
    """De-interleave chroma pairs."""
    side = lambda r: F.filter("px", lambda v, i: i % 2 == r)
    return A.blocks(spark, d).select("vec_id", side(0).alias("u"), side(1).alias("v"))


def half_pel(spark, d):
    """Six-tap horizontal half samples; the window is one line of a plane."""
    w = Window.partitionBy("frame_idx", "y").orderBy("x")
    edge = lambda k: F.coalesce(F.lead("v", k).over(w) if k > 0 else F.lag("v", -k).over(w), F.last("v").over(w.rowsBetween(0, Window.unboundedFollowing)) if k > 0 else F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = A.planes(spark, d)
    raw = edge(-2) - 5 * edge(-1) + 20 * F.col("v") + 20 * edge(1) - 5 * edge(2) + edge(3)
    return p.select("frame_idx", "y", "x", B.clamp(F.shiftright(raw + 16, 5), 0, 255).alias("half"))


HALF_SQL = f"""SELECT p.frame_idx, p.y, p.x, CAST(greatest(0, least(255, (sum(t.c * s.v)::BIGINT + 16) >> 5)) AS INT) AS half FROM ({A.planes_sql()}) p, (VALUES (-2, 1), (-1, -5), (0, 20), (1, 20), (2, -5), (3, 1)) t(o, c)
  JOIN ({A.planes_sql()}) s ON s.frame_idx = p.frame_idx AND s.y = p.y AND s.x = greatest(0, least({W - 1}, p.x + t.o)) GROUP BY p.frame_idx, p.y, p.x"""


def chroma_interp(spark, d):
    """Eighth-sample bilinear interpolation at the fraction (2f + 1, 3f), modulo 8, of each frame, clamped at the edge."""
    # The next sample of a line, then of a column; the last one stands for what is beyond. Windows of one line, so no table of samples is held.
    line, column = Window.partitionBy("frame_idx", "y").orderBy("x"), Window.partitionBy("frame_idx", "x").orderBy("y")
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    out = A.planes(spark, d).withColumn("b", after("v", line)).withColumns({"c": after("v", column), "e": after("b", column)})
    fx, fy = "cast((2 * frame_idx + 1) % 8 as int)", "cast((3 * frame_idx) % 8 as int)"
    return out.select("frame_idx", "y", "x", F.expr(f"shiftright((8 - {fx}) * (8 - {fy}) * v + {fx} * (8 - {fy}) * b + (8 - {fx}) * {fy} * c + {fx} * {fy} * e + 32, 6)").alias("s"))


CHROMA_INTERP_SQL = f"""WITH p AS ({A.planes_sql()}) SELECT p.frame_idx, p.y, p.x, CAST((sum(q.v * (CASE WHEN t.dx = 1 THEN (2 * p.frame_idx + 1) % 8 ELSE 8 - (2 * p.frame_idx + 1) % 8 END) * (CASE WHEN t.dy = 1 THEN 3 * p.frame_idx % 8 ELSE 8 - 3 * p.frame_idx % 8 END))::BIGINT + 32) >> 6 AS INT) AS s
  FROM p, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy) JOIN p q ON q.frame_idx = p.frame_idx AND q.x = least({W - 1}, p.x + t.dx) AND q.y = least({H - 1}, p.y + t.dy) GROUP BY p.frame_idx, p.y, p.x"""


def mv_cost_table(spark, d):
    """Cost of a vector component by its size: round(256 log2(i + 1))."""
    return spark.range(128).select(F.col("id").cast("int").alias("i"), F.rint(256 * F.log2(F.col("id") + 1.0)).cast("int").alias("cost"))


# Intra 4x4 prediction as taps: sample name -> weight, a rounding shift after the sum. T0-T7 above, L0-L3 left, Q the corner.
def _taps(mode: int, x: int, y: int) -> tuple[dict[str, int], int]:
    edge = {**{k: f"T{k}" for k in range(8)}, -1: "Q", **{-2 - k: f"L{k}" for k in range(4)}}  # one line: left column up, corner, top row
    three = lambda k: ({edge[k - 1]: 1, edge[k]: 2, edge[k + 1]: 1}, 2)
    two = lambda k: ({edge[k]: 1, edge[k + 1]: 1}, 1)
    if mode == 0:
        return {f"T{x}": 1}, 0
    if mode == 1:
        return {f"L{y}": 1}, 0
    if mode == 2:
        return {n: 1 for k in range(4) for n in (f"T{k}", f"L{k}")}, 3
    if mode == 3:
        return ({"T6": 1, "T7": 3}, 2) if x == y == 3 else three(x + y + 1)
    if mode == 4:
        return three(x - y - 1)
    if mode == 5:
        z = 2 * x - y
        return two(x - (y >> 1) - 1) if z >= 0 and z % 2 == 0 else three(x - (y >> 1) - 1) if z >= 0 else three(-1) if z == -1 else three(-y)
    if mode == 6:
        z = 2 * y - x
        return two(-2 - (y - (x >> 1))) if z >= 0 and z % 2 == 0 else three(-1 - (y - (x >> 1))) if z >= 0 else three(-1) if z == -1 else three(x - 2)
    if mode == 7:
        return two(x + (y >> 1)) if y % 2 == 0 else three(x + (y >> 1) + 1)
    z = x + 2 * y
    if z > 5:
        return {"L3": 1}, 0
    if z == 5:
        return {"L2": 1, "L3": 3}, 2
    k = y + (x >> 1)
    return ({f"L{k}": 1, f"L{k + 1}": 1}, 1) if z % 2 == 0 else ({f"L{k}": 1, f"L{k + 1}": 2, f"L{k + 2}": 1}, 2)


#: The predicted block is rows and columns 1-4 of an 8x8 block; its neighbours are what lies around. T7 repeats T6.
_WHERE = {"Q": 0, **{f"T{k}": min(k + 1, 7) for k in range(8)}, **{f"L{k}": 8 * (k + 1) for k in range(4)}}


def intra4_modes(spark, d):
    """SAD and SATD of the nine 4x4 predictions of each block."""
    px = F.col("px")

    def predicted(mode):
        out = []
        for y in range(4):
            for x in range(4):
                taps, shift = _taps(mode, x, y)
                s = sum((px[_WHERE[n]] * w for n, w in taps.items()), F.lit((1 << shift) >> 1))
                out.append(F.shiftright(s, shift))
        return F.array(*out)

    src = F.array(*[px[8 * (y + 1) + x + 1] for y in range(4) for x in range(4)])
    r = A.blocks(spark, d).select("vec_id", src.alias("src"), F.posexplode(F.array(*map(predicted, range(9)))).alias("mode", "pred"))
    return r.select("vec_id", "mode", B.sad(F.col("src"), F.col("pred")).alias("sad"), B.satd4x4(B.residual(F.col("src"), F.col("pred"))).alias("satd"))


def intra4_pick(spark, d):
    """Lowest SATD plus lambda (4) times 1 for the probable mode DC, 4 for others; equal costs go to the higher mode."""
    j = F.col("satd") + F.when(F.col("mode") == 2, 4).otherwise(16)
    g = intra4_modes(spark, d).withColumn("j", j).groupBy("vec_id").agg(F.min(F.struct("j", (-F.col("mode")).alias("m"))).alias("b"))
    return g.select("vec_id", (-F.col("b.m")).alias("mode"), F.col("b.j").alias("cost"))


def top_k_modes(spark, d):
    """The three modes of lowest SAD, the first index on ties."""
    w = Window.partitionBy("vec_id").orderBy("sad", "mode")
    return intra4_modes(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vec_id", "rank", "mode", "sad")


def _pred_sql(mode: int) -> str:
    out = []
    for y in range(4):
        for x in range(4):
            taps, shift = _taps(mode, x, y)
            out.append(f"({' + '.join(f'{w} * px[{_WHERE[n] + 1}]' for n, w in taps.items())} + {(1 << shift) >> 1}) >> {shift}")
    return "[" + ", ".join(out) + "]"


_INTRA = "SELECT vec_id, unnest(range(9)) AS mode, unnest([" + ", ".join(_pred_sql(m) for m in range(9)) + f"]) AS pred, list_transform(range(16), lambda i: px[8 * (i // 4 + 1) + i % 4 + 2]) AS src FROM ({A.BLOCKS_SQL})"


def _intra_sql() -> str:
    from blockflow.operators.blockmath import HAD

    return f"""SELECT vec_id, CAST(mode AS INT) AS mode, CAST(list_sum(list_transform(res, lambda v: abs(v))) AS INT) AS sad, CAST((list_sum(list_transform({HAD}, lambda v: abs(v))) + 1)::BIGINT >> 1 AS INT) AS satd
  FROM (SELECT vec_id, mode, list_transform(range(16), lambda i: src[i + 1] - pred[i + 1]) AS res FROM ({_INTRA}))"""


INTRA_SQL = _intra_sql()
CATALOG = {
    "q_pad_extend": (pad_extend, _pad_sql(20, 12, _grid_sql(32, 16))),
    "q_halo": (halo, _pad_sql(20, 12, _grid_sql(36, 28, -8, -8))),
    "q_crop_flip": (crop_flip, f"SELECT frame_idx, 29 - y AS y, x, v FROM ({A.planes_sql()}) WHERE x < 40 AND y < 30"),
    "q_rgb_to_luma": (rgb_to_luma, f"SELECT frame_idx, y, x, 16 + ((66 * r + 129 * g + 25 * b + 128) >> 8) AS luma FROM ({_RGB_SQL})"),
    "q_rgb_to_chroma": (rgb_to_chroma, CHROMA_SQL),
    "q_yuyv_repack": (yuyv_repack, YUYV_SQL),
    "q_uyvy_repack": (uyvy_repack, f"SELECT vec_id, list_transform(range(32), lambda i: px[2 * i + 2]) AS luma, {_yuyv_sql(0)} AS u, {_yuyv_sql(2)} AS v FROM ({A.BLOCKS_SQL})"),
    "q_nv12_split": (nv12_split, f"SELECT vec_id, list_transform(range(32), lambda i: px[2 * i + 1]) AS u, list_transform(range(32), lambda i: px[2 * i + 2]) AS v FROM ({A.BLOCKS_SQL})"),
    "q_half_pel": (half_pel, HALF_SQL),
    "q_chroma_interp": (chroma_interp, CHROMA_INTERP_SQL),
    "q_mv_cost": (mv_cost_table, "SELECT CAST(i AS INT) AS i, CAST(round_even(256 * log2(i + 1.0::DOUBLE), 0) AS INT) AS cost FROM range(128) t(i)"),
    "q_intra4_modes": (intra4_modes, INTRA_SQL),
    "q_intra4_pick": (intra4_pick, f"SELECT vec_id, CAST(min_by(mode, j * 16 - mode) AS INT) AS mode, min(j) AS cost FROM (SELECT *, satd + CASE WHEN mode = 2 THEN 4 ELSE 16 END AS j FROM ({INTRA_SQL})) GROUP BY vec_id"),
    "q_mode_topk": (top_k_modes, f"SELECT * FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY sad, mode) AS rank, mode, sad FROM ({INTRA_SQL})) WHERE rank <= 3"),
}
