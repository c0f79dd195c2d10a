"""Mode decisions, rate terms, availability rules, schedules and reports.

What is plain arithmetic on a row is one SQL text with two dialects (`{d}` is integer division); the rows it
reads come from each engine's own adapters. Neighbours are looked up by windows over a frame's line or column of blocks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import tables as T
from blockflow.operators import bits as S
from blockflow.operators import blockmath as M
from blockflow.operators import frames as R
from blockflow.sources import adapters as A

SLICE_ROWS = "CASE WHEN frame_idx % 2 = 0 THEN 0 ELSE row END"


def both(text: str, source: str):
    """(Spark text over {rows}, DuckDB text over source) of a query written once."""
    return text.replace("{d}", "div").replace("{source}", "{rows}"), text.replace("{d}", "//").replace("{source}", f"({source})")


# Skipping, by the prediction error of a whole macroblock.
def _mb_pairs(spark, d):
    """A macroblock and the next one as its prediction: luma of four 8x8 blocks; the first two stand for chroma, too."""
    m = A.macroblocks(spark, d).select("mb_id", "parts")
    return m.join(m.select((F.col("mb_id") - 1).alias("mb_id"), F.col("parts").alias("pred")), "mb_id").withColumn("qp", (F.col("mb_id") % 52).cast("int"))


def _over(parts: str, pred: str, which, f):
    one = lambda k: f(F.get(parts, F.lit(k)), F.get(pred, F.lit(k)))
    return sum((one(k) for k in which[1:]), one(which[0]))


_MB_PAIRS_SQL = f"SELECT m.mb_id, m.px AS a, n.px AS b, CAST(m.mb_id % 52 AS INT) AS qp FROM ({A.MACROBLOCKS_SQL}) m JOIN ({A.MACROBLOCKS_SQL}) n ON n.mb_id = m.mb_id + 1"


def prediction_sse(spark, d):
    """Squared and absolute error of the prediction over luma and both chroma planes."""
    p = _mb_pairs(spark, d)
    y, uv = (0, 1, 2, 3), (0, 1)
    return p.select("mb_id", "qp", _over("parts", "pred", y, B.ssd).alias("sse_y"), _over("parts", "pred", uv, B.ssd).alias("sse_uv"), (_over("parts", "pred", y, B.sad) + _over("parts", "pred", uv, B.sad)).alias("sad"))


def _sum_sql(n: int, f: str) -> str:
    return f"CAST(list_sum(list_transform(range({n}), lambda i: {f})) AS INT)"


_SQ, _AB = "(a[i + 1] - b[i + 1]) ** 2", "abs(a[i + 1] - b[i + 1])"
SSE_SQL = f"SELECT mb_id, qp, {_sum_sql(256, _SQ)} AS sse_y, {_sum_sql(128, _SQ)} AS sse_uv, {_sum_sql(256, _AB)} + {_sum_sql(128, _AB)} AS sad FROM ({_MB_PAIRS_SQL})"


def skip_gate(spark, d):
    """A macroblock is skipped when its SAD is at most 1536 and its squared error at most 8192, scaled by the QP's lambda against that of 28, from 768 on."""
    gate = B.array_of([min(8192, max(768, 8192 * T.LAMBDA_SATD[q] // T.LAMBDA_SATD[28])) for q in range(52)])
    r = prediction_sse(spark, d).withColumn("gate", F.get(gate, F.col("qp")))
    return r.select("mb_id", "gate", ((F.col("sad") <= 1536) & (F.col("sse_y") + F.col("sse_uv") <= F.col("gate"))).alias("skipped"))


_LAMBDA_SQL = "greatest(1, CAST(floor(0.85::DOUBLE * pow(2.0::DOUBLE, ({q} - 12) / 3.0::DOUBLE) + 0.5) AS INT))"
SKIP_SQL = f"SELECT mb_id, gate, sad <= 1536 AND sse_y + sse_uv <= gate AS skipped FROM (SELECT *, CAST(least(8192, greatest(768, 8192 * {_LAMBDA_SQL.format(q='qp')} // 34)) AS INT) AS gate FROM ({SSE_SQL}))"


def lambdas(spark, d):
    """Lagrange factors of a QP for absolute differences (by steps) and for transformed ones."""
    return spark.range(52).select(F.col("id").cast("int").alias("qp"), F.get(B.array_of(T.LAMBDA_SAD), F.col("id").cast("int")).alias("lambda_sad"), F.get(B.array_of(T.LAMBDA_SATD), F.col("id").cast("int")).alias("lambda_satd"))


LAMBDAS_SQL = f"SELECT qp, CASE WHEN qp <= 18 THEN 1 WHEN qp <= 24 THEN 3 WHEN qp <= 30 THEN 2 WHEN qp <= 36 THEN 6 WHEN qp <= 42 THEN 8 ELSE 10 END AS lambda_sad, {_LAMBDA_SQL.format(q='qp')} AS lambda_satd FROM (SELECT CAST(unnest(range(52)) AS INT) AS qp)"


# Residual costs.
def residual_graph(spark, d):
    """SAD plus a quarter of the residual's gradients; the gradients across the middle lines."""
    r = A.pairs(spark, d).select("vec_id", B.residual(F.col("a"), F.col("b")).alias("r"))
    step = lambda back, ok: F.transform("r", lambda v, i: F.when(ok(i), F.abs(v - F.get("r", i - back))).otherwise(0))
    r = r.withColumn("h", step(1, lambda i: i % 8 > 0)).withColumn("v", step(8, lambda i: i >= 8))
    at = lambda c, ok: B.total(F.filter(c, lambda x, i: ok(i)))
    r = r.withColumn("sad", B.total(F.transform("r", F.abs))).withColumn("gradient", B.total(F.col("h")) + B.total(F.col("v")))
    return r.select("vec_id", "sad", "gradient", at("h", lambda i: i % 8 == 4).alias("mid_x"), at("v", lambda i: F.floor(i / 8) == 4).alias("mid_y"), (F.col("sad") + F.shiftright("gradient", 2)).alias("cost"))


_R = "(a[{k} + 1] - b[{k} + 1])"
_H, _V = f"abs({_R.format(k='i')} - {_R.format(k='(i - 1)')})", f"abs({_R.format(k='i')} - {_R.format(k='(i - 8)')})"
GRAPH_SQL = f"""SELECT vec_id, sad, gradient, mid_x, mid_y, CAST(sad + (gradient::BIGINT >> 2) AS INT) AS cost FROM (SELECT vec_id, {_sum_sql(64, _AB)} AS sad,
  CAST(list_sum(list_transform(list_filter(range(64), lambda i: i % 8 > 0), lambda i: {_H})) + list_sum(list_transform(range(8, 64), lambda i: {_V})) AS INT) AS gradient,
  CAST(list_sum(list_transform(list_filter(range(64), lambda i: i % 8 = 4), lambda i: {_H})) AS INT) AS mid_x, CAST(list_sum(list_transform(range(32, 40), lambda i: {_V})) AS INT) AS mid_y FROM ({A.PAIRS_SQL}))"""


def bounded_satd(spark, d):
    """Costs of the 4x4 blocks are added until the bound is passed: how many were needed, and whether it was."""
    s = A.pairs(spark, d).select("vec_id", F.transform(B.split4(B.residual(F.col("a"), F.col("b")), 8), B.satd4x4).alias("s"), ((F.col("vec_id") * 97) % 4000).cast("int").alias("bound"))
    sums = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: B.total(F.slice("s", 1, k)))
    s = s.withColumn("over", F.array_position(F.transform(sums, lambda x: x > F.col("bound")), True))
    return s.select("vec_id", "bound", (F.col("over") > 0).alias("exceeds"), F.when(F.col("over") > 0, F.col("over")).otherwise(F.size("s")).cast("int").alias("n_blocks"))


BOUNDED_SQL = f"""SELECT vec_id, CAST(vec_id * 97 % 4000 AS INT) AS bound, bool_or(run > vec_id * 97 % 4000) AS exceeds, CAST(coalesce(min(blk + 1) FILTER (WHERE run > vec_id * 97 % 4000), 4) AS INT) AS n_blocks FROM (
  SELECT vec_id, blk, sum((list_sum(list_transform(c, lambda x: abs(x))) + 1)::BIGINT >> 1) OVER (PARTITION BY vec_id ORDER BY blk) AS run FROM (SELECT vec_id, blk, {M.HAD} AS c FROM ({A.RESIDUALS4_SQL}))) GROUP BY vec_id"""


def trellis(spark, d):
    """Each level stays, shrinks by one, or goes, by squared error and rate; the earlier of equal costs stays; then scanned and reconstructed."""
    r = A.residuals4(spark, d).withColumn("coef", B.dct4x4(F.col("res"))).withColumn("level", B.quant4x4(F.col("coef"), F.col("qp")))
    r = r.withColumn("one", B.dequant4x4(F.array_repeat(F.lit(1), 16), F.col("qp"))).withColumn("lam", F.greatest(F.lit(1), (F.pow(F.lit(2.0), (F.col("qp") - 12) / 6.0) * 256 + 0.5).cast("int")))
    rate = lambda v: F.when(v == 0, 0).when(F.abs(v) == 1, 3).otherwise(4 + F.length(F.bin(F.abs(v) - 1)))

    def pick(v, i):
        cost = lambda x: F.pow((F.get("coef", i) - x * F.get("one", i)).cast("double"), F.lit(2)) + F.col("lam") * rate(x)  # noqa: E731  exact: below 2^53
        down = v - F.signum(v).cast("int")
        keep, less, none = cost(v), cost(down), cost(F.lit(0))
        return F.when(v == 0, 0).when((F.abs(v) > 1) & (less < keep), F.when(none < less, 0).otherwise(down)).when(none < keep, 0).otherwise(v)

    r = r.withColumn("kept", F.transform("level", pick)).withColumn("rec", B.idct4x4(B.dequant4x4(F.col("kept"), F.col("qp"))))
    return r.select("vec_id", "blk", F.size(F.filter("kept", lambda v: v != 0)).alias("nnz"), B.zigzag(F.col("kept")).alias("scan"), B.ssd(F.col("res"), F.col("rec")).alias("sse"))


def _cost_sql(x: str) -> str:
    return f"(coef[i] - {x} * one[i])::DOUBLE ** 2 + lam * CASE WHEN {x} = 0 THEN 0 WHEN abs({x}) = 1 THEN 3 ELSE 4 + length(bin(abs({x}) - 1)) END"


_CANDIDATES = f"[{{'k': 0, 'v': level[i], 'c': {_cost_sql('level[i]')}}}, {{'k': 1, 'v': level[i] - CAST(sign(level[i]) AS INT), 'c': CASE WHEN abs(level[i]) > 1 THEN {_cost_sql('(level[i] - CAST(sign(level[i]) AS INT))')} ELSE 1e300 END}}, {{'k': 2, 'v': 0, 'c': {_cost_sql('0')}}}]"
_KEPT_SQL = f"""SELECT vec_id, blk, qp, res, list_transform(range(1, 17), lambda i: list_sort(list_transform({_CANDIDATES}, lambda x: {{'c': x.c, 'k': x.k, 'v': x.v}}))[1].v) AS level FROM (
  SELECT *, greatest(1, CAST(trunc(pow(2.0::DOUBLE, (qp - 12) / 6.0::DOUBLE) * 256 + 0.5) AS INT)) AS lam, {M.DCT} AS coef, list_transform({M._factors(T.NORM_ADJUST)}, lambda f: f * (1 << (qp // 6))) AS one FROM ({M.QUANT_SQL}))"""
TRELLIS_SQL = f"SELECT vec_id, blk, CAST(len(list_filter(level, lambda v: v <> 0)) AS INT) AS nnz, list_transform({list(T.ZIGZAG)}, lambda k: CAST(level[k + 1] AS INT)) AS scan, CAST(list_sum(list_transform(range(16), lambda i: (res[i + 1] - rec[i + 1]) ** 2)) AS INT) AS sse FROM ({M.REC_SQL.replace(M.QUANT_SQL, _KEPT_SQL)})"


def approx_recon(spark, d):
    """The encoder's own reconstruction: a shift and a division by half the multiplier, then a 16x16 matrix over 1024."""
    q = M.quant(spark, d)
    mf = B.by_class([[m >> 1 for m in row] for row in T.QUANT_MF], F.col("qp"))
    size = F.pow(F.lit(2), F.lit(15) + F.floor(F.col("qp") / 6)).cast("long")
    one = lambda v, m: (F.signum(v).cast("long") * F.floor(F.abs(v).cast("long") * size / m)).cast("long")
    q = q.withColumn("fwd", F.zip_with("level", mf, one))
    dot = lambda row: F.aggregate(F.zip_with(B.array_of(row), F.col("fwd"), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
    trunc = lambda s: (F.signum(s).cast("long") * F.floor(F.abs(s) / 1024)).cast("int")
    return q.select("vec_id", "blk", "fwd", F.array(*[trunc(dot(row)) for row in T.INVERSE]).alias("rec"))


_MF_HALF = f"{[[row[T.position_class(k)] >> 1 for k in range(16)] for row in T.QUANT_MF]}[CAST(qp % 6 AS INT) + 1]"
APPROX_SQL = f"""SELECT vec_id, blk, fwd, list_transform({T.INVERSE}, lambda m: CAST(trunc(list_sum(list_transform(range(16), lambda i: m[i + 1] * fwd[i + 1])) / 1024.0::DOUBLE) AS INT)) AS rec FROM (
  SELECT vec_id, blk, list_transform(range(16), lambda i: CAST(sign(level[i + 1]) AS BIGINT) * ((abs(level[i + 1])::BIGINT << CAST(15 + qp // 6 AS INT)) // mh[i + 1])) AS fwd FROM (SELECT *, {_MF_HALF} AS mh FROM ({M.QUANT_SQL})))"""


def chroma_dc_simple(spark, d):
    """Chroma DC by the halved multiplier of the corner class: levels, and what they stand for."""
    c = M.chroma_dc(spark, d).select("vec_id", "coef", (F.col("vec_id") % 52).cast("int").alias("qp"))
    c = c.withColumn("mf", F.get(B.array_of([row[0] >> 1 for row in T.QUANT_MF]), F.col("qp") % 6).cast("long")).withColumn("size", F.pow(F.lit(2), F.lit(15) + F.floor(F.col("qp") / 6)).cast("long"))
    sign = lambda v: F.when(v < 0, -1).otherwise(1)
    c = c.withColumn("level", F.transform("coef", lambda v: (sign(v) * F.floor((F.abs(v).cast("long") * F.col("mf") + F.col("size") / 2) / F.col("size"))).cast("int")))
    return c.select("vec_id", "level", F.transform("level", lambda v: (sign(v) * F.floor(F.abs(v).cast("long") * F.col("size") / F.col("mf"))).cast("int")).alias("back"))


_C_SIGN = "CASE WHEN {v} < 0 THEN -1 ELSE 1 END"
CHROMA_SIMPLE_SQL = f"""SELECT vec_id, level, list_transform(level, lambda v: CAST({_C_SIGN.format(v='v')} * ((abs(v)::BIGINT << s) // mf) AS INT)) AS back FROM (SELECT *, list_transform(coef, lambda v: CAST({_C_SIGN.format(v='v')} * ((abs(v)::BIGINT * mf + (1::BIGINT << (s - 1))) >> s) AS INT)) AS level FROM (
  SELECT vec_id, coef, {[row[0] >> 1 for row in T.QUANT_MF]}[CAST(vec_id % 52 % 6 AS INT) + 1] AS mf, CAST(15 + vec_id % 52 // 6 AS INT) AS s FROM ({M.CHROMA_DC_SQL})))"""


def luma_dc_inverse(spark, d):
    """The DC transform there and back: 16 times the input, so a rounded shift by 4 gives it again."""
    r = M._dc16(spark, d)
    back = F.transform(B.hadamard4x4(B.hadamard4x4(F.col("dc"))), lambda v: F.shiftright(v + 8, 4))
    return r.select("mb_id", back.alias("back"), (back == F.col("dc")).alias("same"))


# Intra prediction of macroblocks.
_RASTER = [(y // 8 * 2 + x // 8, y % 8 * 8 + x % 8) for y in range(16) for x in range(16)]


def _with_neighbours(spark, d):
    """Macroblocks with px in raster order, the row above, the column to the left and the corner; other slices are not there."""
    m = A.macroblocks(spark, d).select("frame_idx", "mb_idx", "mb_id", F.expr(f"cast(mb_idx div {A.MB_COLS} as int)").alias("row"), (F.col("mb_idx") % A.MB_COLS).alias("col"), F.flatten("parts").alias("q"))
    at = F.lit([p * 64 + k for p, k in _RASTER])
    m = m.withColumn("px", F.transform(at, lambda i: F.get("q", i))).drop("q")
    w, up = Window.partitionBy("frame_idx", "row").orderBy("col"), Window.partitionBy("frame_idx", "col").orderBy("row")
    column = lambda px: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda y: F.get(px, y * 16 + 15))
    here = (F.col("frame_idx") % 2 == 0) & (F.col("row") > 0)  # frames of odd number have a slice for each row
    last = F.struct(F.slice("px", 241, 16).alias("line"), column(F.col("px")).alias("side"), F.element_at("px", 256).alias("end"))
    m = m.withColumn("edge", last).withColumn("left", F.lag("edge").over(w)).withColumn("above", F.when(here, F.lag("edge").over(up)))
    corner = Window.partitionBy("frame_idx").orderBy("mb_idx")
    m = m.withColumn("corner", F.when(here & (F.col("col") > 0), F.lag("edge", A.MB_COLS + 1).over(corner)["end"]))
    return m.select("frame_idx", "mb_idx", "mb_id", "row", "col", "px", F.col("above.line").alias("top"), F.col("left.side").alias("side"), "corner")


_M_RASTER = f"SELECT frame_idx, mb_idx, mb_id, mb_idx // {A.MB_COLS} AS row, mb_idx % {A.MB_COLS} AS col, list_transform({[p * 64 + k + 1 for p, k in _RASTER]}, lambda i: px[i]) AS px FROM ({A.MACROBLOCKS_SQL})"
_M_NEAR = f"""SELECT m.*, a.px[241:256] AS top, list_transform(range(16), lambda y: l.px[y * 16 + 16]) AS side0, l.mb_id IS NOT NULL AS has_side, c.px[256] AS corner FROM ({_M_RASTER}) m
  LEFT JOIN ({_M_RASTER}) a ON a.frame_idx = m.frame_idx AND a.row = m.row - 1 AND a.col = m.col AND m.frame_idx % 2 = 0 LEFT JOIN ({_M_RASTER}) l ON l.frame_idx = m.frame_idx AND l.row = m.row AND l.col = m.col - 1
  LEFT JOIN ({_M_RASTER}) c ON c.frame_idx = m.frame_idx AND c.row = m.row - 1 AND c.col = m.col - 1 AND m.frame_idx % 2 = 0"""
NEAR_SQL = f"SELECT * EXCLUDE (side0, has_side), CASE WHEN has_side THEN side0 END AS side FROM ({_M_NEAR})"


def _slope(far, near, half: int, corner):
    """The weighted sum of differences along an edge; the last one reaches the corner."""
    g = lambda a, i: F.get(a, F.lit(i))
    return sum(((i + 1) * (g(far, half + i) - (corner if i == half - 1 else g(near, half - 2 - i))) for i in range(half)), F.lit(0))


def intra16(spark, d):
    """SAD of the four intra 16x16 modes; null where a mode's neighbours are missing."""
    m = _with_neighbours(spark, d)
    both_sum, n = F.coalesce(B.total(F.col("top")), F.lit(0)) + F.coalesce(B.total(F.col("side")), F.lit(0)), F.when(F.col("top").isNull(), 0).otherwise(16) + F.when(F.col("side").isNull(), 0).otherwise(16)
    m = m.withColumn("dc", F.when(n == 0, 128).otherwise(F.floor((both_sum + n / 2) / n)).cast("int"))
    m = m.withColumn("b", F.shiftright(5 * _slope(F.col("top"), F.col("top"), 8, F.col("corner")) + 32, 6)).withColumn("c", F.shiftright(5 * _slope(F.col("side"), F.col("side"), 8, F.col("corner")) + 32, 6))
    m = m.withColumn("a", 16 * (F.get("side", F.lit(15)) + F.get("top", F.lit(15))))
    sad = lambda pred: B.total(F.transform("px", lambda v, i: F.abs(v - pred(i))))
    y = lambda i: F.shiftright(i, 4)
    plane = lambda i: B.clamp(F.shiftright(F.col("a") + F.col("b") * (i % 16 - 7) + F.col("c") * (y(i) - 7) + 16, 5), 0, 255)
    return m.select("mb_id", sad(lambda i: F.get("top", i % 16)).alias("sad_v"), sad(lambda i: F.get("side", y(i))).alias("sad_h"), sad(lambda i: F.col("dc")).alias("sad_dc"), F.when(F.col("corner").isNotNull(), sad(plane)).alias("sad_plane"))


def _slope_list(edge: str, half: int) -> str:
    return f"CAST(list_sum(list_transform(range({half}), lambda i: (i + 1) * ({edge}[{half} + i + 1] - CASE WHEN i = {half - 1} THEN corner ELSE {edge}[{half - 1} - i] END))) AS BIGINT)"


_SAD16 = "CAST(list_sum(list_transform(range(256), lambda i: abs(px[i + 1] - {p}))) AS INT)"
INTRA16_SQL = f"""SELECT mb_id, CASE WHEN top IS NOT NULL THEN {_SAD16.format(p='top[i % 16 + 1]')} END AS sad_v, CASE WHEN side IS NOT NULL THEN {_SAD16.format(p='side[i // 16 + 1]')} END AS sad_h, {_SAD16.format(p='dc')} AS sad_dc,
  CASE WHEN corner IS NOT NULL THEN {_SAD16.format(p='greatest(0, least(255, (a + b * (i % 16 - 7) + c * (i // 16 - 7) + 16) >> 5))')} END AS sad_plane FROM (
  SELECT *, CASE WHEN top IS NULL AND side IS NULL THEN 128 WHEN top IS NULL THEN (list_sum(side) + 8)::BIGINT >> 4 WHEN side IS NULL THEN (list_sum(top) + 8)::BIGINT >> 4 ELSE (list_sum(top) + list_sum(side) + 16)::BIGINT >> 5 END AS dc,
    (5 * {_slope_list('top', 8)} + 32) >> 6 AS b, (5 * {_slope_list('side', 8)} + 32) >> 6 AS c, 16 * (side[16] + top[16])::BIGINT AS a FROM ({NEAR_SQL}))"""


def intra16_pick(spark, d):
    """The best intra 16x16 mode: DC, vertical, horizontal, plane in that order, by strictly smaller SAD."""
    order = F.array(*[F.struct(F.col(c).alias("sad"), F.lit(k).alias("k"), F.lit(m).alias("mode")) for k, (c, m) in enumerate((("sad_dc", 2), ("sad_v", 0), ("sad_h", 1), ("sad_plane", 3)))])
    best = F.array_min(F.filter(order, lambda s: s["sad"].isNotNull()))
    return intra16(spark, d).select("mb_id", best["mode"].alias("mode"), best["sad"].alias("sad"))


PICK16_SQL = f"""SELECT mb_id, CAST(CASE WHEN sad_dc <= least(v, h, p) THEN 2 WHEN v <= least(h, p) THEN 0 WHEN h <= p THEN 1 ELSE 3 END AS INT) AS mode, least(sad_dc, v, h, p) AS sad FROM (
  SELECT *, coalesce(sad_v, 99999999) AS v, coalesce(sad_h, 99999999) AS h, coalesce(sad_plane, 99999999) AS p FROM ({INTRA16_SQL}))"""


def chroma_intra(spark, d):
    """Costs of the four intra chroma modes over two planes (the first and second 8x8 blocks): SAD plus lambda times 1, 3, 3, 5; and the best."""
    m = A.macroblocks(spark, d).select("frame_idx", "mb_idx", "mb_id", F.expr(f"cast(mb_idx div {A.MB_COLS} as int)").alias("row"), (F.col("mb_idx") % A.MB_COLS).alias("col"), "parts")
    w, up, at = Window.partitionBy("frame_idx", "row").orderBy("col"), Window.partitionBy("frame_idx", "col").orderBy("row"), Window.partitionBy("frame_idx").orderBy("mb_idx")
    here = (F.col("frame_idx") % 2 == 0) & (F.col("row") > 0)
    m = m.withColumn("l", F.lag("parts").over(w)).withColumn("t", F.when(here, F.lag("parts").over(up))).withColumn("k", F.when(here & (F.col("col") > 0), F.lag("parts", A.MB_COLS + 1).over(at)))
    m = m.select("mb_id", "parts", "l", "t", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("plane"))
    p = lambda c: F.get(c, F.col("plane"))
    m = m.select("mb_id", "plane", p("parts").alias("px"), F.slice(p("t"), 57, 8).alias("top"), F.transform(p("l"), lambda v, i: F.when(i % 8 == 7, v)).alias("s"), F.get(p("k"), F.lit(63)).alias("corner"))
    m = m.withColumn("side", F.filter("s", lambda v: v.isNotNull()))
    four = lambda e, k: B.total(F.slice(e, 4 * k + 1, 4))
    t, s = (lambda k: four("top", k)), (lambda k: four("side", k))
    one, two = (lambda x: F.shiftright(x + 2, 2)), (lambda x, y: F.shiftright(x + y + 4, 3))
    full = F.array(two(t(0), s(0)), one(t(1)), one(s(1)), two(t(1), s(1)))
    dc = F.when(F.col("top").isNotNull() & F.col("side").isNotNull(), full).when(F.col("top").isNotNull(), F.array(one(t(0)), one(t(1)), one(t(0)), one(t(1)))).when(F.col("side").isNotNull(), F.array(one(s(0)), one(s(0)), one(s(1)), one(s(1)))).otherwise(B.array_of([128] * 4))
    m = m.withColumn("dc", dc).withColumn("b", F.shiftright(34 * _slope(F.col("top"), F.col("top"), 4, F.col("corner")) + 32, 6)).withColumn("c", F.shiftright(34 * _slope(F.col("side"), F.col("side"), 4, F.col("corner")) + 32, 6))
    m = m.withColumn("a", 16 * (F.get("side", F.lit(7)) + F.get("top", F.lit(7))))
    sad = lambda pred: B.total(F.transform("px", lambda v, i: F.abs(v - pred(i))))
    y = lambda i: F.shiftright(i, 3)
    plane = lambda i: B.clamp(F.shiftright(F.col("a") + F.col("b") * (i % 8 - 3) + F.col("c") * (y(i) - 3) + 16, 5), 0, 255)
    m = m.select("mb_id", sad(lambda i: F.get("dc", F.shiftright(i, 5) * 2 + F.shiftright(i % 8, 2))).alias("s0"), sad(lambda i: F.get("side", y(i))).alias("s1"), sad(lambda i: F.get("top", i % 8)).alias("s2"), F.when(F.col("corner").isNotNull(), sad(plane)).alias("s3"))
    lam = F.get(B.array_of(T.LAMBDA_SAD), (F.col("mb_id") % 52).cast("int"))
    m = m.groupBy("mb_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    m = m.select("mb_id", *[(F.col(f"s{k}") + lam * n).alias(f"cost{k}") for k, n in enumerate((1, 3, 3, 5))])
    best = F.array_min(F.filter(F.array(*[F.struct(F.col(f"cost{k}").alias("c"), F.lit(k).alias("k")) for k in range(4)]), lambda x: x["c"].isNotNull()))
    return m.select("mb_id", "cost0", "cost1", "cost2", "cost3", best["k"].alias("mode"))


_CM = f"SELECT frame_idx, mb_idx, mb_id, mb_idx // {A.MB_COLS} AS row, mb_idx % {A.MB_COLS} AS col, px FROM ({A.MACROBLOCKS_SQL})"
_C_NEAR = f"""SELECT m.mb_id, g AS plane, m.px[g * 64 + 1:g * 64 + 64] AS px, t.px[g * 64 + 57:g * 64 + 64] AS top, CASE WHEN l.mb_id IS NOT NULL THEN list_transform(range(8), lambda y: l.px[g * 64 + y * 8 + 8]) END AS side, k.px[g * 64 + 64] AS corner FROM ({_CM}) m CROSS JOIN (SELECT unnest([0, 1]) AS g)
  LEFT JOIN ({_CM}) t ON t.frame_idx = m.frame_idx AND t.row = m.row - 1 AND t.col = m.col AND m.frame_idx % 2 = 0 LEFT JOIN ({_CM}) l ON l.frame_idx = m.frame_idx AND l.row = m.row AND l.col = m.col - 1 LEFT JOIN ({_CM}) k ON k.frame_idx = m.frame_idx AND k.row = m.row - 1 AND k.col = m.col - 1 AND m.frame_idx % 2 = 0"""
_F4 = "CAST(list_sum({e}[{a}:{b}]) AS BIGINT)"
_T0, _T1, _L0, _L1 = (_F4.format(e=e, a=a, b=a + 3) for e in ("top", "side") for a in (1, 5))
_SAD8 = "list_sum(list_transform(range(64), lambda i: abs(px[i + 1] - {p})))"
CHROMA_INTRA_SQL = f"""SELECT mb_id, cost0, cost1, cost2, cost3, CAST(CASE WHEN cost0 <= least(c1, c2, c3) THEN 0 WHEN c1 <= least(c2, c3) THEN 1 WHEN c2 <= c3 THEN 2 ELSE 3 END AS INT) AS mode FROM (SELECT *, coalesce(cost1, 99999999) AS c1, coalesce(cost2, 99999999) AS c2, coalesce(cost3, 99999999) AS c3 FROM (
  SELECT mb_id, CAST(sum(s0) + max(lam) AS BIGINT) AS cost0, CAST(sum(s1) + 3 * max(lam) AS BIGINT) AS cost1, CAST(sum(s2) + 3 * max(lam) AS BIGINT) AS cost2, CAST(sum(s3) + 5 * max(lam) AS BIGINT) AS cost3 FROM (
    SELECT mb_id, {list(T.LAMBDA_SAD)}[CAST(mb_id % 52 AS INT) + 1] AS lam, {_SAD8.format(p='dc[i // 32 * 2 + i % 8 // 4 + 1]')} AS s0, CASE WHEN side IS NOT NULL THEN {_SAD8.format(p='side[i // 8 + 1]')} END AS s1, CASE WHEN top IS NOT NULL THEN {_SAD8.format(p='top[i % 8 + 1]')} END AS s2,
      CASE WHEN corner IS NOT NULL THEN {_SAD8.format(p='greatest(0, least(255, (a + b * (i % 8 - 3) + c * (i // 8 - 3) + 16) >> 5))')} END AS s3 FROM (
      SELECT *, CASE WHEN top IS NOT NULL AND side IS NOT NULL THEN [({_T0} + {_L0} + 4) >> 3, ({_T1} + 2) >> 2, ({_L1} + 2) >> 2, ({_T1} + {_L1} + 4) >> 3] WHEN top IS NOT NULL THEN [({_T0} + 2) >> 2, ({_T1} + 2) >> 2, ({_T0} + 2) >> 2, ({_T1} + 2) >> 2]
        WHEN side IS NOT NULL THEN [({_L0} + 2) >> 2, ({_L0} + 2) >> 2, ({_L1} + 2) >> 2, ({_L1} + 2) >> 2] ELSE [128, 128, 128, 128] END AS dc, (34 * {_slope_list('top', 4)} + 32) >> 6 AS b, (34 * {_slope_list('side', 4)} + 32) >> 6 AS c, 16 * (side[8] + top[8])::BIGINT AS a FROM ({_C_NEAR}))) GROUP BY mb_id))"""

# Which samples a 4x4 block may read. Modes need: above 0 3 7, left 1 8, both (and the corner) 4 5 6, none 2.
_ORDER = [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]
_ALLOWED = [
    f"CASE WHEN {' AND '.join(f'({c})' for c in conditions)} THEN {1 << mode} ELSE 0 END"
    for mode in range(9)
    for conditions in [[
        "true", *(["col4 > 0 OR left_mb"] if mode in (1, 8, 4, 5, 6) else []), *(["row4 > 0 OR above_mb"] if mode in (0, 3, 7, 4, 5, 6) else []), *(["row4 > 0 OR col4 > 0 OR corner_mb"] if mode in (4, 5, 6) else []),
        *(["above_mb", "left_mb OR NOT (row4 = 0 AND col4 = 2 OR row4 = 2 AND col4 IN (0, 2))"] if mode in (1, 8) else []), *(["above_mb OR NOT (row4 = 1 AND col4 <= 1)"] if mode in (0, 3, 7, 4, 5, 6) else []),
    ]]
]
_AVAILABILITY = """SELECT mb_id, row4, col4, above_mb OR row4 > 0 AS has_above, left_mb OR col4 > 0 AS has_left,
  (above_mb OR row4 > 0) AND CASE WHEN col4 = 3 THEN row4 = 0 AND above_mb AND corner_right WHEN row4 = 0 THEN above_mb ELSE before_right END AS has_above_right, """ + " + ".join(_ALLOWED) + """ AS modes FROM {source}"""


def _usable(spark, d):
    """4x4 blocks of macroblocks: which neighbours there are in the slice and, where inter ones may not be read, are intra."""
    f = S._field(spark, d).selectExpr("*", f"{SLICE_ROWS} AS first_row", "mb_id % 3 = 0 AS constrained")
    w = Window.partitionBy("frame_idx").orderBy("mb_idx")
    n = A.MB_COLS
    fine = lambda k: ~F.col("constrained") | F.coalesce(F.lag("intra", k).over(w), F.lit(False))
    above = F.col("row") > F.col("first_row")
    f = f.withColumn("left_mb", (F.col("col") > 0) & fine(1)).withColumn("above_mb", above & fine(n)).withColumn("corner_mb", above & (F.col("col") > 0) & fine(n + 1)).withColumn("corner_right", above & (F.col("col") < n - 1) & fine(n - 1))
    f = f.select("mb_id", "left_mb", "above_mb", "corner_mb", "corner_right", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    f = f.selectExpr("*", "cast(k div 4 as int) AS row4", "cast(k % 4 as int) AS col4")
    order = B.array_of(_ORDER)
    return f.withColumn("before_right", F.when((F.col("row4") > 0) & (F.col("col4") < 3), F.get(order, F.col("k") - 3) < F.get(order, F.col("k"))).otherwise(False))


_FINE = "(NOT (m.mb_id % 3 = 0) OR coalesce({x}.intra, false))"
_USABLE_SQL = f"""SELECT mb_id, left_mb, above_mb, corner_mb, corner_right, k // 4 AS row4, k % 4 AS col4, k >= 4 AND k % 4 < 3 AND {_ORDER}[greatest(k - 3, 0) + 1] < {_ORDER}[k + 1] AS before_right FROM (SELECT *, CAST(unnest(range(16)) AS INT) AS k FROM (
  SELECT m.mb_id, m.col > 0 AND {_FINE.format(x='l')} AS left_mb, up AND {_FINE.format(x='a')} AS above_mb, up AND m.col > 0 AND {_FINE.format(x='c')} AS corner_mb, up AND m.col < {A.MB_COLS - 1} AND {_FINE.format(x='r')} AS corner_right
  FROM (SELECT *, frame_idx % 2 = 0 AND row > 0 AS up FROM ({S.FIELD_SQL})) m LEFT JOIN ({S.FIELD_SQL}) l ON l.mb_id = m.mb_id - 1 LEFT JOIN ({S.FIELD_SQL}) a ON a.mb_id = m.mb_id - {A.MB_COLS} LEFT JOIN ({S.FIELD_SQL}) c ON c.mb_id = m.mb_id - {A.MB_COLS + 1} LEFT JOIN ({S.FIELD_SQL}) r ON r.mb_id = m.mb_id - {A.MB_COLS - 1}))"""
_AVAILABILITY_SPARK, AVAILABILITY_SQL = both(_AVAILABILITY, _USABLE_SQL)


def availability(spark, d):
    """Neighbours of each 4x4 block and the modes it may use, as a bit mask."""
    return spark.sql(_AVAILABILITY_SPARK, rows=_usable(spark, d))


_NEEDS = """CASE WHEN mode IN (1, 8, 4, 5, 6) AND col4 = 0 AND NOT left_mb OR mode IN (0, 3, 7, 4, 5, 6) AND row4 = 0 AND NOT above_mb OR mode IN (4, 5, 6) AND row4 = 0 AND col4 = 0 AND NOT corner_mb THEN false ELSE true END"""
_DECODABLE = f"SELECT mb_id, bool_and(ok) AS decodable, count(CASE WHEN NOT ok THEN 1 END) AS n_bad FROM (SELECT mb_id, {_NEEDS} AS ok FROM (SELECT *, (mb_id * 7 + row4 * 3 + col4) % 9 AS mode FROM {{source}})) GROUP BY mb_id"


def decodable(spark, d):
    """Whether sixteen chosen modes can be decoded: none reads samples that are not there."""
    return spark.sql(_DECODABLE.replace("{source}", "{rows}"), rows=_usable(spark, d))


# The samples that the chosen modes miss, as unions of what each kind of mode needs.
DECODABLE_SQL = f"""WITH u AS (SELECT *, (mb_id * 7 + row4 * 3 + col4) % 9 AS mode FROM ({_USABLE_SQL})),
bad AS (SELECT mb_id, row4, col4 FROM u WHERE mode IN (1, 4, 5, 6, 8) AND col4 = 0 AND NOT left_mb UNION SELECT mb_id, row4, col4 FROM u WHERE mode IN (0, 3, 4, 5, 6, 7) AND row4 = 0 AND NOT above_mb UNION SELECT mb_id, row4, col4 FROM u WHERE mode IN (4, 5, 6) AND row4 = 0 AND col4 = 0 AND NOT corner_mb)
SELECT m.mb_id, count(b.mb_id) = 0 AS decodable, count(b.mb_id) AS n_bad FROM (SELECT DISTINCT mb_id FROM u) m LEFT JOIN bad b ON b.mb_id = m.mb_id GROUP BY m.mb_id"""

# Motion decisions.
_SKIP_MV = """SELECT mb_id, CASE WHEN a_ref IS NULL OR b_ref IS NULL OR a_ref = 0 AND a_x = 0 AND a_y = 0 OR b_ref = 0 AND b_x = 0 AND b_y = 0 THEN 0 ELSE px END AS skip_x,
  CASE WHEN a_ref IS NULL OR b_ref IS NULL OR a_ref = 0 AND a_x = 0 AND a_y = 0 OR b_ref = 0 AND b_x = 0 AND b_y = 0 THEN 0 ELSE py END AS skip_y FROM {source}"""


def skip_mv(spark, d):
    """Vector of a skipped macroblock: none at an edge or beside a still neighbour, else the predictor. Motion is coarse, so that stillness occurs."""
    w = Window.partitionBy("frame_idx").orderBy("mb_idx")
    f = S._field(spark, d).selectExpr("*", "cast(mvx div 64 as int) AS cx", "cast(mvy div 64 as int) AS cy")
    left, up = F.col("col") > 0, F.col("row") > 0
    near = lambda ok, k, p: [F.when(ok, F.lag(c, k).over(w)).alias(f"{p}_{n}") for c, n in (("ref", "ref"), ("cx", "x"), ("cy", "y"))]
    f = f.select("mb_id", *near(left, 1, "a"), *near(up, A.MB_COLS, "b"))
    return spark.sql(_SKIP_MV.replace("{source}", "{rows}"), rows=f.join(S.mv_predictor(spark, d), "mb_id"))


_COARSE = f"SELECT *, CAST(trunc(mvx / 64.0::DOUBLE) AS INT) AS cx, CAST(trunc(mvy / 64.0::DOUBLE) AS INT) AS cy FROM ({S.FIELD_SQL})"
SKIP_MV_SQL = _SKIP_MV.replace("{source}", f"(SELECT m.mb_id, a.ref AS a_ref, a.cx AS a_x, a.cy AS a_y, b.ref AS b_ref, b.cx AS b_x, b.cy AS b_y, p.px, p.py FROM ({_COARSE}) m JOIN ({S.MV_PREDICTOR_SQL}) p ON p.mb_id = m.mb_id LEFT JOIN ({_COARSE}) a ON a.frame_idx = m.frame_idx AND a.row = m.row AND a.col = m.col - 1 LEFT JOIN ({_COARSE}) b ON b.frame_idx = m.frame_idx AND b.row = m.row - 1 AND b.col = m.col)")

# Blocks of a frame of 3 x 2 macroblocks with a halo of 24 samples; six-tap filters read 2 before and 3 behind.
_BOUNDS = """SELECT mb_id, mvx, mvy, x0 + (mvx >> 2) - CASE WHEN mvx & 3 = 0 THEN 0 ELSE 2 END >= -24 AND x0 + 15 + (mvx >> 2) + CASE WHEN mvx & 3 = 0 THEN 0 ELSE 3 END < 48 + 24
    AND y0 + (mvy >> 2) - CASE WHEN mvy & 3 = 0 THEN 0 ELSE 2 END >= -24 AND y0 + 15 + (mvy >> 2) + CASE WHEN mvy & 3 = 0 THEN 0 ELSE 3 END < 32 + 24 AS inside,
  x0 + 15 + (mvx >> 2) + CASE WHEN mvx & 3 <> 0 THEN 3 ELSE 0 END < upto AND (x0 >> 1) + 7 + (mvx >> 3) + CASE WHEN mvx & 7 <> 0 THEN 1 ELSE 0 END < (upto >> 1) - 1 AS refresh_safe, upto - x0 - 21 AS max_safe_int
  FROM (SELECT *, col * 16 AS x0, row * 16 AS y0, 16 + mb_id % 3 * 16 AS upto FROM {source})"""
_BOUNDS_SPARK, BOUNDS_SQL = both(_BOUNDS, S.FIELD_SQL)


def mv_bounds(spark, d):
    """Whether a block with its filter taps stays in the padded planes, and left of the part that a refresh wave has cleaned."""
    return spark.sql(_BOUNDS_SPARK, rows=S._field(spark, d))


_MAG = "(greatest(abs(tx), abs(ty)) >> 2)"
_CLAMP = "greatest(8, least(32, {x}))"
_RANGE = f"""SELECT mb_id, base, probed, probed AND sad_probe < sad_skip >> 1 AS explained, CAST(CASE WHEN sad_skip > 2048 AND probed AND sad_probe < sad_skip >> 1 THEN {_CLAMP.format(x=_MAG + ' + 4')} WHEN sad_skip > 2048 THEN greatest(base, CASE WHEN sad_skip > 4096 THEN 32 ELSE 24 END)
  WHEN tx IS NOT NULL AND base < 16 THEN greatest(base, {_CLAMP.format(x=_MAG + ' + 2')}) ELSE base END AS INT) AS range FROM (
  SELECT *, CASE WHEN variance < 64 THEN 8 WHEN variance < 512 THEN 16 ELSE 32 END AS base, sad_skip > 2048 AND tx IS NOT NULL AND (tx <> skip_x OR ty <> skip_y) AS probed FROM {{source}})"""


def search_range(spark, d):
    """Motion range from variance, widened where the skip prediction is poor, unless a probe at the vector of the same place in the frame
    before explains the motion. The macroblock two further stands for the probed prediction."""
    f = S._field(spark, d).selectExpr("mb_id + 6 AS mb_id", "mvx AS tx", "mvy AS ty")
    m = A.macroblocks(spark, d).select("mb_id", "parts")
    probe = m.join(m.select((F.col("mb_id") - 2).alias("mb_id"), F.col("parts").alias("pred")), "mb_id").select("mb_id", _over("parts", "pred", (0, 1, 2, 3), B.sad).alias("sad_probe"))
    rows = M.mb_variance(spark, d).select("mb_id", "variance").join(prediction_sse(spark, d).select("mb_id", F.col("sad").alias("sad_skip")), "mb_id").join(probe, "mb_id").join(skip_mv(spark, d), "mb_id").join(f, "mb_id", "left")
    return spark.sql(_RANGE.replace("{source}", "{rows}"), rows=rows)


RANGE_SQL = _RANGE.replace("{source}", f"""(SELECT v.mb_id, v.variance, s.sad AS sad_skip, p.sad_probe, k.skip_x, k.skip_y, f.mvx AS tx, f.mvy AS ty FROM ({M.MB_VARIANCE_SQL}) v JOIN ({SSE_SQL}) s ON s.mb_id = v.mb_id
  JOIN (SELECT m.mb_id, CAST(list_sum(list_transform(range(256), lambda i: abs(m.px[i + 1] - n.px[i + 1]))) AS INT) AS sad_probe FROM ({A.MACROBLOCKS_SQL}) m JOIN ({A.MACROBLOCKS_SQL}) n ON n.mb_id = m.mb_id + 2) p ON p.mb_id = v.mb_id JOIN ({SKIP_MV_SQL}) k ON k.mb_id = v.mb_id LEFT JOIN ({S.FIELD_SQL}) f ON f.mb_id = v.mb_id - 6)""")

_UE_BITS = "(2 * length(bin({n} + 1)) - 1)"
_SE_BITS = _UE_BITS.format(n="(CASE WHEN {v} <= 0 THEN -2 * ({v}) ELSE 2 * ({v}) - 1 END)")
_INTRA_P = f"""SELECT mb_id, inter_bits, intra_bits, inter_rd, intra_rd, i4_rd, intra_rd + (intra_rd >> 2) < inter_rd AS use_i16, NOT (intra_rd + (intra_rd >> 2) < inter_rd) AND inter_satd >= 3000 AND i4_rd + (i4_rd >> 2) < inter_rd AND i4_rd < intra_rd AS use_i4 FROM (
  SELECT *, inter_satd + lam * inter_bits AS inter_rd, intra_satd + lam * intra_bits AS intra_rd, i4_satd + lam * (intra_bits + 16) AS i4_rd FROM (
    SELECT *, {_UE_BITS.format(n='shape')} + 4 * vectors + vectors * ({_SE_BITS.format(v='mvx')} + {_SE_BITS.format(v='mvy')}) + 8 AS inter_bits, {_UE_BITS.format(n='(18 + mode)')} + 64 AS intra_bits FROM {{source}}))"""


def intra_in_inter(spark, d):
    """Whether an inter macroblock is coded as intra: 16x16 at 1.25 times its cost, 4x4 only where inter is poor (3000), by SATD and estimated bits."""
    p = _mb_pairs(spark, d)
    satd = _over("parts", "pred", (0, 1, 2, 3), lambda a, b: B.satd(B.residual(a, b), 8))
    p = p.select("mb_id", "qp", satd.cast("long").alias("inter_satd"))
    p = p.join(intra16_pick(spark, d).select("mb_id", "mode", F.col("sad").cast("long").alias("sad")), "mb_id").join(S._field(spark, d).select("mb_id", "mvx", "mvy"), "mb_id")
    p = p.selectExpr("mb_id", "inter_satd", "sad AS intra_satd", "(sad * 3) div 4 AS i4_satd", "mode", "mvx", "mvy", "cast(mb_id % 4 as int) AS shape", "cast(element_at(array(1, 2, 2, 4), cast(mb_id % 4 + 1 as int)) as int) AS vectors", f"element_at(array({', '.join(map(str, T.LAMBDA_SATD))}), qp + 1) AS lam")
    return spark.sql(_INTRA_P.replace("{source}", "{rows}"), rows=p)


_SATD16 = f"SELECT vec_id // 4 AS mb_id, CAST(sum((list_sum(list_transform(c, lambda x: abs(x))) + 1)::BIGINT >> 1) AS BIGINT) AS inter_satd FROM (SELECT vec_id, {M.HAD} AS c FROM (SELECT vec_id, list_transform(range(16), lambda i: a[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1] - b[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1]) AS res FROM (SELECT x.vec_id, x.px AS a, y.px AS b FROM ({A.BLOCKS_SQL}) x JOIN ({A.BLOCKS_SQL}) y ON y.vec_id = x.vec_id + 4), (SELECT unnest(range(4)) AS k))) GROUP BY 1 HAVING count(*) = 16"
_INTRA_P_SQL = _INTRA_P.replace("{source}", f"(SELECT p.mb_id, inter_satd, CAST(sad AS BIGINT) AS intra_satd, CAST(sad AS BIGINT) * 3 // 4 AS i4_satd, mode, mvx, mvy, CAST(p.mb_id % 4 AS INT) AS shape, [1, 2, 2, 4][CAST(p.mb_id % 4 AS INT) + 1] AS vectors, {list(T.LAMBDA_SATD)}[CAST(p.mb_id % 52 AS INT) + 1] AS lam FROM ({_SATD16}) p JOIN ({PICK16_SQL}) i ON i.mb_id = p.mb_id JOIN ({S.FIELD_SQL}) f ON f.mb_id = p.mb_id)")

_EFFORT = """SELECT mb_id, effort, consumed, tier, CASE tier WHEN 3 THEN 8 WHEN 2 THEN 16 ELSE 32 END AS seed_range, tier < 1 AS exhaustive, tier < 2 AS second_reference, tier < 3 AND variance >= 64 AS sub_partitions,
  least(CASE tier WHEN 3 THEN 4 WHEN 2 THEN 4 WHEN 1 THEN 8 ELSE 16 END, CASE WHEN searched > greatest(8, 6 {d} 4) THEN 4 ELSE 16 END) AS range_cap FROM (
  SELECT *, CASE WHEN consumed >= budget THEN 3 WHEN consumed >= budget - (budget >> 2) THEN 2 WHEN consumed >= budget >> 1 THEN 1 ELSE 0 END AS tier FROM (
    SELECT *, CAST(coalesce(sum(effort) OVER (PARTITION BY frame_idx ORDER BY mb_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS consumed, count(CASE WHEN variance >= 64 THEN 1 END) OVER (PARTITION BY frame_idx ORDER BY mb_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS searched,
      greatest(1, 512 * 6 {d} 2) AS budget FROM (SELECT mb_id, frame_idx, mb_idx, variance, variance % 1024 AS effort FROM {source})))"""
_EFFORT_SPARK, EFFORT_SQL = both(_EFFORT, M.MB_VARIANCE_SQL)


def effort_tiers(spark, d):
    """Effort spent before each macroblock against its slice's budget (512 a macroblock, two slices): at 50, 75 and 100 % search terms go."""
    return spark.sql(_EFFORT_SPARK, rows=M.mb_variance(spark, d))


_ROWS_EFFORT = "SELECT frame_idx, mb_idx {d} 3 AS row, CAST(sum(variance % 1024) AS BIGINT) AS effort, round(avg(variance), 6) AS mean_variance, max(variance) AS top FROM {source} GROUP BY frame_idx, mb_idx {d} 3"
_ROWS_SPARK, ROWS_SQL = both(_ROWS_EFFORT, M.MB_VARIANCE_SQL)


def row_report(spark, d):
    """Search effort that each row of macroblocks adds to the running counter, and averages by row."""
    return spark.sql(_ROWS_SPARK, rows=M.mb_variance(spark, d)).select("frame_idx", F.col("row").cast("int").alias("row"), "effort", "mean_variance", "top")


_REFERENCE = """SELECT vec_id, probe, searched, CASE WHEN searched AND s1 + 2 * lam < s0 THEN 1 ELSE 0 END AS reference FROM (SELECT *, s0 > least(1024, 32 * lam) + 2 * lam OR probe + 2 * lam < s0 AS searched FROM (
  SELECT vec_id, s0, s1, least(s1, s2) AS probe, lam FROM {source}))"""


def reference_choice(spark, d):
    """The second reference is searched where the first is poor or a cheap probe promises a margin, and wins by twice lambda. References are the next two blocks."""
    b = A.blocks(spark, d)
    n = lambda k: b.select((F.col("vec_id") - k).alias("vec_id"), F.col("px").alias(f"p{k}"))
    r = b.join(n(1), "vec_id").join(n(2), "vec_id").join(n(3), "vec_id")
    r = r.select("vec_id", *[B.sad(F.col("px"), F.col(f"p{k + 1}")).alias(f"s{k}") for k in range(3)], F.get(B.array_of(T.LAMBDA_SATD), (F.col("vec_id") % 40).cast("int")).alias("lam"))
    return spark.sql(_REFERENCE.replace("{source}", "{rows}"), rows=r)


_SADS = ", ".join(f"CAST(list_sum(list_transform(range(64), lambda i: abs(x.px[i + 1] - y{k}.px[i + 1]))) AS INT) AS s{k}" for k in range(3))
REFERENCE_SQL = _REFERENCE.replace("{source}", f"(SELECT x.vec_id, {_SADS}, {list(T.LAMBDA_SATD)}[CAST(x.vec_id % 40 AS INT) + 1] AS lam FROM ({A.BLOCKS_SQL}) x JOIN ({A.BLOCKS_SQL}) y0 ON y0.vec_id = x.vec_id + 1 JOIN ({A.BLOCKS_SQL}) y1 ON y1.vec_id = x.vec_id + 2 JOIN ({A.BLOCKS_SQL}) y2 ON y2.vec_id = x.vec_id + 3)")


def top_four(spark, d):
    """The four cheapest modes of a block in order of cost; of equal ones the earlier."""
    r = R.intra4_modes(spark, d).groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("satd", "mode"))), 1, 4).alias("s"))  # nine modes a block
    return r.select("vec_id", F.transform("s", lambda x: x["mode"]).alias("modes"), F.transform("s", lambda x: x["satd"]).alias("costs"))


TOP_SQL = f"SELECT vec_id, list(mode ORDER BY satd, mode)[1:4] AS modes, list(satd ORDER BY satd, mode)[1:4] AS costs FROM ({R.INTRA_SQL}) GROUP BY vec_id"


def satd_counters(spark, d):
    """By shape: how often the bounded cost was cut short, and a histogram of the blocks it took."""
    b = bounded_satd(spark, d).withColumn("shape", (F.col("vec_id") % 4).cast("int"))
    return b.groupBy("shape", F.width_bucket(F.col("n_blocks").cast("double"), F.lit(1.0), F.lit(5.0), F.lit(4)).cast("int").alias("depth")).agg(F.count_if("exceeds").alias("cut"), F.count_if(~F.col("exceeds")).alias("full"))


COUNTERS_SQL = f"SELECT CAST(vec_id % 4 AS INT) AS shape, n_blocks AS depth, count(*) FILTER (WHERE exceeds) AS cut, count(*) FILTER (WHERE NOT exceeds) AS full FROM ({BOUNDED_SQL}) GROUP BY 1, 2"

def observed(rows, name: str = "phases"):
    """(rows, observation): counters that gather while rows are computed, at no pass of their own; observation.get has them after an action.
    rows: decisions with inter_rd, intra_rd, use_i16 and use_i4."""
    from pyspark.sql import Observation

    seen = Observation(name)
    one = lambda c: F.count_if(c)
    return rows.observe(seen, F.count(F.lit(1)).alias("macroblocks"), one(F.col("use_i16")).alias("intra16"), one(F.col("use_i4")).alias("intra4"), F.avg("inter_rd").alias("mean_inter_rd"), F.avg("intra_rd").alias("mean_intra_rd")), seen



def phase_counters(spark, d):
    """What the counters beside the intra decision of inter macroblocks gathered while its rows were computed."""
    rows, seen = observed(intra_in_inter(spark, d))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["macroblocks"], got["intra16"], got["intra4"], round(got["mean_inter_rd"] or 0.0, 3), round(got["mean_intra_rd"] or 0.0, 3))], "macroblocks long, intra16 long, intra4 long, mean_inter_rd double, mean_intra_rd double")


# Ladders, budgets and schedules over sessions; customers stand for sessions, feedback rows for frames.
_LADDER = """SELECT id, bps, least(CASE WHEN bps >= 8000000 THEN 0 WHEN bps >= 5000000 THEN 1 WHEN bps >= 3000000 THEN 2 WHEN bps >= 1500000 THEN 3 ELSE 4 END, rungs - 1) AS rung, CASE WHEN bps >= 4000000 THEN 60 WHEN bps >= 2000000 THEN 30 ELSE 15 END AS fps,
  cast(max_bytes * 2.0 as int) AS idr_budget, encoded > cast(max_bytes * 2.0 as int) AS exceeded FROM {source}"""
_SESSIONS = "SELECT id, bps, CASE WHEN n_w = 0 OR n_h = 0 THEN 5 ELSE least(n_w, n_h) END AS rungs, max_bytes, encoded FROM (SELECT c_custkey AS id, (c_custkey * 7919) % 12000000 AS bps, c_custkey % 4 AS n_w, c_custkey % 3 AS n_h, c_custkey % 9000 + 100 AS max_bytes, c_custkey * 31 % 20000 AS encoded FROM {customer})"


def ladder_pick(spark, d):
    """Rung and frame rate of a bitrate, on a ladder as long as the shorter of its lists (none: the default of five), and the budget of a full picture."""
    s = spark.sql(_SESSIONS, customer=A.table(spark, d, "customer"))
    return spark.sql(_LADDER.replace("{source}", "{rows}"), rows=s)


def ladder_config(spark, d):
    """Ladders from configured widths and heights: paired by place, the shorter list ends it, an empty one gives the default."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    c = c.withColumn("w", F.slice(B.array_of([1280, 960, 640, 320]), 1, (F.col("id") % 5).cast("int"))).withColumn("h", F.slice(B.array_of([720, 540, 360]), 1, (F.col("id") % 4).cast("int")))
    own = F.slice(F.arrays_zip("w", "h"), 1, F.least(F.size("w"), F.size("h")))
    default = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h, _ in T.RESOLUTIONS])
    c = c.select("id", F.posexplode(F.when(F.size(own) > 0, own).otherwise(default)).alias("rung", "r"))
    return c.select("id", "rung", F.col("r.w").alias("width"), F.col("r.h").alias("height"), F.concat(F.col("r.h").cast("string"), F.lit("p")).alias("name"))


CONFIG_SQL = f"""SELECT id, CAST(k - 1 AS INT) AS rung, w[k] AS width, h[k] AS height, CAST(h[k] AS VARCHAR) || 'p' AS name FROM (SELECT id, CASE WHEN n = 0 THEN {[r[0] for r in T.RESOLUTIONS]} ELSE [1280, 960, 640, 320] END AS w, CASE WHEN n = 0 THEN {[r[1] for r in T.RESOLUTIONS]} ELSE [720, 540, 360] END AS h, unnest(range(1, CASE WHEN n = 0 THEN 6 ELSE n + 1 END)) AS k FROM (
  SELECT c_custkey AS id, least(c_custkey % 5, c_custkey % 4) AS n FROM customer))"""

_SCHEDULE = """SELECT stream_id, seq, idr, gop_id, frame_num, CAST((gop_id - 1) % 65536 AS INT) AS idr_pic_id FROM (SELECT *, CAST((row_number() OVER (PARTITION BY stream_id, gop_id ORDER BY seq) - 1) % 16 AS INT) AS frame_num FROM (
  SELECT *, CAST(sum(CASE WHEN idr THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS gop_id FROM (SELECT stream_id, seq, seq = 0 OR fir OR seq % 12 = 0 AS idr FROM {source})))"""


def idr_schedule(spark, d):
    """Full pictures: the first, forced ones, and each twelfth; numbers of pictures and groups that follow from it."""
    return spark.sql(_SCHEDULE.replace("{source}", "{rows}"), rows=A.feedback(spark, d))


_MIX = """SELECT frame_idx, row, count(CASE WHEN NOT intra AND skip THEN 1 END) AS n_skip, count(CASE WHEN NOT intra AND NOT skip AND cbp % 4 = 0 THEN 1 END) AS n_inter16, count(CASE WHEN NOT intra AND NOT skip AND cbp % 4 <> 0 THEN 1 END) AS n_inter_sub, count(CASE WHEN intra THEN 1 END) AS n_intra FROM {source} GROUP BY frame_idx, row"""


def row_mix(spark, d):
    """Macroblocks of a row by kind: skipped, inter in one part (pattern divisible by 4), inter in parts, intra."""
    return spark.sql(_MIX.replace("{source}", "{rows}"), rows=S._field(spark, d))


def capture_sizes(spark, d):
    """Distinct sizes that a device offers, by area."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = A.table(spark, d, "events").select(F.col("user_id").alias("device"), (k % 5 * 160 + 320).alias("width"), (k % 5 * 90 + 180).alias("height")).distinct()
    w = Window.partitionBy("device").orderBy(F.col("width") * F.col("height"), "width")
    return e.select("device", "width", "height", F.row_number().over(w).alias("nth"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
SIZES_SQL = f"SELECT device, width, height, CAST(row_number() OVER (PARTITION BY device ORDER BY width * height, width) AS INT) AS nth FROM (SELECT DISTINCT user_id AS device, {_K} % 5 * 160 + 320 AS width, {_K} % 5 * 90 + 180 AS height FROM events)"

CATALOG = {
    "q_prediction_sse": (prediction_sse, SSE_SQL),
    "q_skip_gate": (skip_gate, SKIP_SQL),
    "q_lambdas": (lambdas, LAMBDAS_SQL),
    "q_residual_graph": (residual_graph, GRAPH_SQL),
    "q_bounded_satd": (bounded_satd, BOUNDED_SQL),
    "q_trellis": (trellis, TRELLIS_SQL),
    "q_approx_recon": (approx_recon, APPROX_SQL),
    "q_chroma_dc_simple": (chroma_dc_simple, CHROMA_SIMPLE_SQL),
    "q_luma_dc_inverse": (luma_dc_inverse, f"SELECT mb_id, res AS back, true AS same FROM ({M.DC16_SQL})"),
    "q_intra16": (intra16, INTRA16_SQL),
    "q_intra16_pick": (intra16_pick, PICK16_SQL),
    "q_chroma_intra": (chroma_intra, CHROMA_INTRA_SQL),
    "q_availability": (availability, AVAILABILITY_SQL),
    "q_decodable": (decodable, DECODABLE_SQL),
    "q_skip_mv": (skip_mv, SKIP_MV_SQL),
    "q_search_range": (search_range, RANGE_SQL),
    "q_mv_bounds": (mv_bounds, BOUNDS_SQL),
    "q_intra_in_inter": (intra_in_inter, _INTRA_P_SQL),
    "q_phase_counters": (phase_counters, f"SELECT count(*) AS macroblocks, count(*) FILTER (WHERE use_i16) AS intra16, count(*) FILTER (WHERE use_i4) AS intra4, round(avg(inter_rd), 3) AS mean_inter_rd, round(avg(intra_rd), 3) AS mean_intra_rd FROM ({_INTRA_P_SQL})"),
    "q_effort_tiers": (effort_tiers, EFFORT_SQL),
    "q_row_report": (row_report, ROWS_SQL),
    "q_reference_choice": (reference_choice, REFERENCE_SQL),
    "q_top_four": (top_four, TOP_SQL),
    "q_satd_counters": (satd_counters, COUNTERS_SQL),
    "q_ladder_pick": (ladder_pick, _LADDER.replace("{source}", f"({_SESSIONS.format(customer='customer')})")),
    "q_ladder_config": (ladder_config, CONFIG_SQL),
    "q_idr_schedule": (idr_schedule, _SCHEDULE.replace("{source}", f"({A.FEEDBACK_SQL})")),
    "q_row_mix": (row_mix, _MIX.replace("{source}", f"({S.FIELD_SQL})")),
    "q_capture_sizes": (capture_sizes, SIZES_SQL),
}
