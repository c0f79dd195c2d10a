"""Distances, transforms, quantisation and macroblock statistics.

Every query is a projection over block rows; only the pairing of a block with its successor
and the gathering of a macroblock's four blocks shuffle, each on its own key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions import tables as T
from blockflow.sources import adapters as A


def _total(x: str) -> str:
    return f"CAST(list_sum({x}) AS BIGINT)"


def _lin(matrix, x: str) -> str:
    return f"list_transform({[list(r) for r in matrix]}, lambda row: CAST(list_sum(list_transform(range(16), lambda i: row[i + 1] * {x}[i + 1])) AS INT))"


DCT, HAD = _lin(T.two_sided(T.CORE), "res"), _lin(T.two_sided(T.HADAMARD), "res")


def _factors(table) -> str:
    return f"{[[row[T.position_class(k)] for k in range(16)] for row in table]}[CAST(qp % 6 AS INT) + 1]"


def sad_pairs(spark, d):
    return A.pairs(spark, d).select("vec_id", B.sad(F.col("a"), F.col("b")).alias("sad"))


def ssd_pairs(spark, d):
    return A.pairs(spark, d).select("vec_id", B.ssd(F.col("a"), F.col("b")).alias("ssd"))


def psnr_pairs(spark, d):
    r = A.pairs(spark, d).select("vec_id", B.ssd(F.col("a"), F.col("b")).alias("ssd"))
    return r.select("vec_id", F.expr("CASE WHEN ssd > 0 THEN round(10 * log10(65025.0D / (ssd / 64.0D)), 6) END").alias("psnr"))


def agreement_pairs(spark, d):
    near = F.filter(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda v: v <= 8)
    return A.pairs(spark, d).select("vec_id", F.size(near).alias("n_near"), (F.size(near) / F.lit(64.0)).alias("share"))


def satd_pairs(spark, d):
    r = A.residuals4(spark, d).select("vec_id", B.satd4x4(F.col("res")).alias("s"))
    return r.groupBy("vec_id").agg(F.sum("s").alias("satd"))


def satd_lower_bound(spark, d):
    r = A.residuals4(spark, d).select("vec_id", "blk", B.satd4x4(F.col("res")).alias("satd"), F.shiftright(B.total(F.transform("res", F.abs)) + 1, 1).alias("bound"))
    return r.withColumn("holds", F.col("bound") <= F.col("satd"))


def dct(spark, d):
    return A.residuals4(spark, d).select("vec_id", "blk", B.dct4x4(F.col("res")).alias("coef"))


def hadamard(spark, d):
    return A.residuals4(spark, d).select("vec_id", "blk", B.hadamard4x4(F.col("res")).alias("coef"))


def transform_domain_satd(spark, d):
    """Hadamard is linear: both sides are transformed once, coefficients are differenced."""
    p = A.pairs(spark, d).select("vec_id", F.transform(B.split4(F.col("a"), 8), B.hadamard4x4).alias("ha"), F.transform(B.split4(F.col("b"), 8), B.hadamard4x4).alias("hb"))
    one = lambda x, y: F.shiftright(B.sad(x, y) + 1, 1)
    return p.select("vec_id", B.total(F.zip_with("ha", "hb", one)).cast("long").alias("satd"))


def quant(spark, d):
    r = A.residuals4(spark, d).select("vec_id", "blk", "qp", B.dct4x4(F.col("res")).alias("coef"))
    return r.select("vec_id", "blk", "qp", B.quant4x4(F.col("coef"), F.col("qp")).alias("level"))


def dequant_idct(spark, d):
    r = quant(spark, d).withColumn("deq", B.dequant4x4(F.col("level"), F.col("qp")))
    return r.select("vec_id", "blk", "deq", B.idct4x4(F.col("deq")).alias("rec"))


def residual_bundle(spark, d):
    """Forward, quantise, scan and reconstruct in one row: level count, zig-zag levels, squared error."""
    r = A.residuals4(spark, d).withColumn("coef", B.dct4x4(F.col("res"))).withColumn("level", B.quant4x4(F.col("coef"), F.col("qp")))
    r = r.withColumn("rec", B.idct4x4(B.dequant4x4(F.col("level"), F.col("qp"))))
    return r.select("vec_id", "blk", F.size(F.filter("level", lambda v: v != 0)).alias("nnz"), B.zigzag(F.col("level")).alias("scan"), B.ssd(F.col("res"), F.col("rec")).alias("sse"))


QUANT_SQL = f"""SELECT vec_id, blk, qp, res, list_transform(range(16), lambda i: CAST(sign(coef[i + 1]) * ((abs(coef[i + 1])::BIGINT * mf[i + 1] + (1::BIGINT << (14 + qp // 6))) >> (15 + qp // 6)) AS INT)) AS level
  FROM (SELECT *, {DCT} AS coef, {_factors(T.QUANT_MF)} AS mf FROM ({A.RESIDUALS4_SQL}))"""
DEQ_SQL = f"""SELECT *, list_transform(range(16), lambda i: level[i + 1] * v[i + 1] * (1 << (qp // 6))) AS deq FROM (SELECT *, {_factors(T.NORM_ADJUST)} AS v FROM ({QUANT_SQL}))"""


def _inv(src: str, out: str, step: int, base: int) -> str:
    """SQL of one inverse pass over lines of a block: element k of a line is src[base*line + step*k]."""
    at = lambda k: f"{src}[i // 4 * {base} + {k} * {step} + 1]"
    even = f"CASE i % 4 WHEN 0 THEN {at(0)} + {at(2)} WHEN 3 THEN {at(0)} + {at(2)} ELSE {at(0)} - {at(2)} END"
    odd = f"CASE i % 4 WHEN 0 THEN {at(1)} + ({at(3)} >> 1) WHEN 1 THEN ({at(1)} >> 1) - {at(3)} WHEN 2 THEN {at(3)} - ({at(1)} >> 1) ELSE -({at(1)} + ({at(3)} >> 1)) END"
    return f"list_transform(range(16), lambda i: ({even}) + ({odd})) AS {out}"


REC_SQL = f"""SELECT *, list_transform(range(16), lambda k: CAST((c[(k % 4) * 4 + k // 4 + 1] + 32) >> 6 AS INT)) AS rec
  FROM (SELECT *, {_inv('r', 'c', 4, 1)} FROM (SELECT *, {_inv('deq', 'r', 1, 4)} FROM ({DEQ_SQL})))"""


def _dc16(spark, d):
    """mb_id, dc: the DC coefficients of a macroblock's sixteen 4x4 blocks in raster order, and a QP."""
    rows = A.macroblocks(spark, d)
    dcs = F.flatten(F.transform("parts", lambda p: F.transform(B.split4(p, 8), B.total)))
    order = [(r // 2 * 2 + c // 2) * 4 + (r % 2) * 2 + c % 2 for r in range(4) for c in range(4)]
    return rows.withColumn("z", dcs).select("mb_id", F.array(*[F.col("z")[k] for k in order]).alias("dc"), (F.col("mb_id") % 52).cast("int").alias("qp"))


def luma_dc_hadamard(spark, d):
    return _dc16(spark, d).select("mb_id", B.hadamard4x4(F.col("dc")).alias("coef"))


_DC_ORDER = [(r // 2 * 2 + c // 2) * 4 + (r % 2) * 2 + c % 2 for r in range(4) for c in range(4)]
DC16_SQL = f"""SELECT mb_id, list_transform({_DC_ORDER}, lambda k: z[k + 1]) AS res FROM (SELECT mb_id, list_transform(range(16), lambda k:
  CAST(list_sum(list_transform(range(16), lambda i: px[(k // 4) * 64 + ((k % 4 // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1])) AS INT)) AS z FROM ({A.MACROBLOCKS_SQL}))"""


def chroma_dc(spark, d):
    """2x2 Hadamard of the four DC values of an 8x8 block, and its inverse with (x + 2) >> 2."""
    had = lambda a, b, c, e: F.array(a + b + c + e, a - b + c - e, a + b - c - e, a - b - c + e)
    r = A.blocks(spark, d).select("vec_id", F.transform(B.split4(F.col("px"), 8), B.total).alias("dc"))
    r = r.withColumn("coef", had(*[F.col("dc")[k] for k in range(4)]))
    return r.select("vec_id", "coef", F.transform(had(*[F.col("coef")[k] for k in range(4)]), lambda v: F.shiftright(v + 2, 2)).alias("back"))


_H2 = [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]
CHROMA_DC_SQL = f"""SELECT vec_id, coef, list_transform({_H2}, lambda r: CAST((list_sum(list_transform(range(4), lambda i: r[i + 1] * coef[i + 1])) + 2) AS BIGINT) >> 2) AS back FROM
  (SELECT vec_id, list_transform({_H2}, lambda r: CAST(list_sum(list_transform(range(4), lambda i: r[i + 1] * dc[i + 1])) AS INT)) AS coef FROM
  (SELECT vec_id, list_transform(range(4), lambda k: CAST(list_sum(list_transform(range(16), lambda i: px[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1])) AS INT)) AS dc FROM ({A.BLOCKS_SQL})))"""


def _mb_variance(spark, d):
    """Sums of each 8x8 block are added, so a macroblock's samples are never laid out."""
    sums = lambda f: F.aggregate(F.transform("parts", lambda p: B.total(F.transform(p, f))), F.lit(0).cast("long"), lambda s, v: s + v)
    r = A.macroblocks(spark, d).withColumn("s", sums(lambda x: x)).withColumn("ss", sums(lambda x: x * x))
    return r.select("mb_id", "frame_idx", "mb_idx", F.expr("(256 * ss - s * s) div 65536").alias("variance"))


MB_VARIANCE_SQL = f"""SELECT mb_id, frame_idx, mb_idx, (256 * ss - s * s) // 65536 AS variance FROM
  (SELECT *, {_total('px')} AS s, {_total('list_transform(px, lambda x: x * x)')} AS ss FROM ({A.MACROBLOCKS_SQL}))"""


def mb_variance(spark, d):
    return _mb_variance(spark, d)


def low_variance_blocks(spark, d):
    r = A.blocks(spark, d).select("vec_id", F.posexplode(B.split4(F.col("px"), 8)).alias("blk", "p"))
    return r.select("vec_id", "blk", (16 * B.total(F.transform("p", lambda x: x * x)) - B.total(F.col("p")) * B.total(F.col("p")) < 256 * 256).alias("low"))


def texture_frame(spark, d):
    """Mean log2 activity of the macroblocks in even rows and columns of whole frames, over 12, in [0, 1]."""
    v = _mb_variance(spark, d)
    even = (F.expr(f"mb_idx div {A.MB_COLS}") % 2 == 0) & (F.col("mb_idx") % A.MB_COLS % 2 == 0)
    act = F.avg(F.when(even, F.log2(F.greatest("variance", F.lit(1)).cast("double"))))
    g = v.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(even, 1)).alias("sampled"), act.alias("a")).where(F.col("n") == A.MBS_PER_FRAME)
    return g.select("frame_idx", "sampled", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a") / 12)), 9).alias("texture"))


TEXTURE_SQL = f"""SELECT frame_idx, count(*) FILTER (WHERE e) AS sampled, round(least(1.0, greatest(0.0, avg(log2(greatest(variance, 1)::DOUBLE)) FILTER (WHERE e) / 12)), 9) AS texture FROM
  (SELECT *, mb_idx // {A.MB_COLS} % 2 = 0 AND mb_idx % {A.MB_COLS} % 2 = 0 AS e FROM ({MB_VARIANCE_SQL})) GROUP BY frame_idx HAVING count(*) = {A.MBS_PER_FRAME}"""


def aq_offsets(spark, d, strength: float = 1.0):
    """Half-even rounding of strength times the distance of log2 variance from its frame mean, clamped to 6."""
    v = _mb_variance(spark, d).withColumn("l", F.log2(F.greatest("variance", F.lit(1)).cast("double")))
    w = Window.partitionBy("frame_idx")  # MBS_PER_FRAME rows a frame
    off = F.rint(F.round(F.lit(strength) * (F.col("l") - F.avg("l").over(w)), 9)).cast("int")
    return v.select("mb_id", F.greatest(F.lit(-6), F.least(F.lit(6), off)).alias("qp_offset"))


AQ_SQL = f"""SELECT mb_id, CAST(greatest(-6, least(6, round_even(round(1.0::DOUBLE * (l - avg(l) OVER (PARTITION BY frame_idx)), 9), 0))) AS INT) AS qp_offset FROM
  (SELECT *, log2(greatest(variance, 1)::DOUBLE) AS l FROM ({MB_VARIANCE_SQL}))"""


def approx_rate_bits(spark, d):
    """0 for a zero level, 3 for one, else 4 plus the bit length of the rest."""
    r = quant(spark, d).select("vec_id", "blk", F.explode("level").alias("l"))
    bits = F.when(F.col("l") == 0, 0).when(F.abs("l") == 1, 3).otherwise(4 + F.length(F.bin(F.abs("l") - 1)))
    return r.groupBy("vec_id", "blk").agg(F.sum(bits).alias("rate_bits"))


_abs = "list_transform(res, lambda x: abs(x))"
CATALOG = {
    "q_sad_pairs": (sad_pairs, f"SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1]))) AS INT) AS sad FROM ({A.PAIRS_SQL})"),
    "q_ssd_pairs": (ssd_pairs, f"SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: (a[i + 1] - b[i + 1]) ** 2)) AS INT) AS ssd FROM ({A.PAIRS_SQL})"),
    "q_psnr_pairs": (psnr_pairs, f"SELECT vec_id, CASE WHEN s > 0 THEN round(10 * log10(65025.0::DOUBLE / (s / 64.0::DOUBLE)), 6) END AS psnr FROM (SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: (a[i + 1] - b[i + 1]) ** 2)) AS INT) AS s FROM ({A.PAIRS_SQL}))"),
    "q_pixel_agreement": (agreement_pairs, f"SELECT vec_id, CAST(n AS INT) AS n_near, n / 64.0::DOUBLE AS share FROM (SELECT vec_id, len(list_filter(range(64), lambda i: abs(a[i + 1] - b[i + 1]) <= 8)) AS n FROM ({A.PAIRS_SQL}))"),
    "q_satd_pairs": (satd_pairs, f"SELECT vec_id, CAST(sum((list_sum(list_transform(c, lambda x: abs(x))) + 1)::BIGINT >> 1) AS BIGINT) AS satd FROM (SELECT vec_id, {HAD} AS c FROM ({A.RESIDUALS4_SQL})) GROUP BY vec_id"),
    "q_satd_transform_domain": (transform_domain_satd, f"SELECT vec_id, CAST(sum((list_sum(list_transform(c, lambda x: abs(x))) + 1)::BIGINT >> 1) AS BIGINT) AS satd FROM (SELECT vec_id, {HAD} AS c FROM ({A.RESIDUALS4_SQL})) GROUP BY vec_id"),
    "q_satd_lower_bound": (satd_lower_bound, f"SELECT *, bound <= satd AS holds FROM (SELECT vec_id, blk, (list_sum(list_transform({HAD}, lambda x: abs(x))) + 1)::BIGINT >> 1 AS satd, (list_sum({_abs}) + 1)::BIGINT >> 1 AS bound FROM ({A.RESIDUALS4_SQL}))"),
    "q_dct4x4": (dct, f"SELECT vec_id, blk, {DCT} AS coef FROM ({A.RESIDUALS4_SQL})"),
    "q_hadamard4x4": (hadamard, f"SELECT vec_id, blk, {HAD} AS coef FROM ({A.RESIDUALS4_SQL})"),
    "q_quant4x4": (quant, f"SELECT vec_id, blk, qp, level FROM ({QUANT_SQL})"),
    "q_dequant_idct": (dequant_idct, f"SELECT vec_id, blk, deq, rec FROM ({REC_SQL})"),
    "q_residual_bundle": (residual_bundle, f"SELECT vec_id, blk, CAST(len(list_filter(level, lambda v: v <> 0)) AS INT) AS nnz, list_transform({list(T.ZIGZAG)}, lambda k: level[k + 1]) AS scan, CAST(list_sum(list_transform(range(16), lambda i: (res[i + 1] - rec[i + 1]) ** 2)) AS INT) AS sse FROM ({REC_SQL})"),
    "q_luma_dc_hadamard": (luma_dc_hadamard, f"SELECT mb_id, {HAD} AS coef FROM ({DC16_SQL})"),
    "q_chroma_dc": (chroma_dc, CHROMA_DC_SQL),
    "q_mb_variance": (mb_variance, MB_VARIANCE_SQL),
    "q_low_variance_blocks": (low_variance_blocks, f"SELECT vec_id, k AS blk, 16 * list_sum(list_transform(p, lambda x: x * x)) - list_sum(p) ** 2 < 65536 AS low FROM (SELECT vec_id, k, list_transform(range(16), lambda i: px[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1]) AS p FROM ({A.BLOCKS_SQL}), (SELECT unnest(range(4)) AS k))"),
    "q_texture_frame": (texture_frame, TEXTURE_SQL),
    "q_aq_offsets": (aq_offsets, AQ_SQL),
    "q_rate_bits": (approx_rate_bits, f"SELECT vec_id, blk, CAST(list_sum(list_transform(level, lambda l: CASE WHEN l = 0 THEN 0 WHEN abs(l) = 1 THEN 3 ELSE 4 + length(bin(abs(l) - 1)) END)) AS BIGINT) AS rate_bits FROM ({QUANT_SQL})"),
}
