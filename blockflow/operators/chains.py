"""DC coefficient chains, mode signalling, code numbers, capture-format choice and the refresh wave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockflow.functions import blocks as B
from blockflow.functions.folds import folded
from blockflow.functions import tables as T
from blockflow.operators import bits as S
from blockflow.operators import blockmath as M
from blockflow.sources import adapters as A

HALVED = [row[0] >> 1 for row in T.QUANT_MF]
DC_SCALE = [16 * row[0] for row in T.NORM_ADJUST]
# Capture formats in order of preference.
PREFERENCE = ("view", "click", "purchase")


def _dc_levels(spark, d):
    r = M._dc16(spark, d).select("mb_id", "qp", B.hadamard4x4(F.col("dc")).alias("c"))
    mf, bits = B.array_of(HALVED)[F.col("qp") % 6], F.lit(15) + F.floor(F.col("qp") / 6).cast("int")
    half, size = F.pow(F.lit(2), bits - 1).cast("long"), F.pow(F.lit(2), bits).cast("long")
    q = F.transform("c", lambda v: (F.when(v < 0, -1).otherwise(1) * F.floor((F.abs(v).cast("long") * mf + half) / size)).cast("int"))
    return r.select("mb_id", "qp", q.alias("level"))


def luma_dc_quant(spark, d):
    return _dc_levels(spark, d)


def luma_dc_recon(spark, d):
    """Decoder-exact: unnormalised inverse, then a left shift from QP 36 on, a rounding right shift below."""
    r = _dc_levels(spark, d).withColumn("f", B.hadamard4x4(F.col("level"))).withColumn("scale", B.array_of(DC_SCALE)[F.col("qp") % 6])
    up, down = F.pow(F.lit(2), F.floor(F.col("qp") / 6) - 6).cast("int"), F.pow(F.lit(2), 6 - F.floor(F.col("qp") / 6)).cast("int")
    big = F.transform("f", lambda v: v * F.col("scale") * up)
    small = F.transform("f", lambda v: F.floor((v * F.col("scale") + down / 2) / down).cast("int"))
    return r.select("mb_id", F.when(F.col("qp") >= 36, big).otherwise(small).alias("dc"))


_HC = M._lin(T.two_sided(T.HADAMARD), "res")
DC_LEVEL_SQL = f"""SELECT mb_id, qp, list_transform(c, lambda v: CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * ((abs(v)::BIGINT * mf + (1::BIGINT << (14 + qp // 6))) >> (15 + qp // 6)) AS INT)) AS level FROM (
  SELECT mb_id, CAST(mb_id % 52 AS INT) AS qp, {HALVED}[CAST(mb_id % 52 % 6 AS INT) + 1] AS mf, {_HC} AS c FROM ({M.DC16_SQL}))"""
DC_RECON_SQL = f"""SELECT mb_id, list_transform(f, lambda v: CAST(CASE WHEN qp >= 36 THEN (v * s)::BIGINT * (1::BIGINT << greatest(0, qp // 6 - 6)) ELSE ((v * s)::BIGINT + (1::BIGINT << greatest(0, 5 - qp // 6))) >> greatest(1, 6 - qp // 6) END AS INT)) AS dc FROM (
  SELECT mb_id, qp, {DC_SCALE}[CAST(qp % 6 AS INT) + 1] AS s, {M._lin(T.two_sided(T.HADAMARD), 'level')} AS f FROM ({DC_LEVEL_SQL}))"""


def chroma_dc_levels(spark, d):
    """Levels of the four DC values (half-even, clamped to 2048) and the values that a decoder gets back."""
    r = A.blocks(spark, d).select("vec_id", (F.col("vec_id") % 52).cast("int").alias("qp"), F.transform(B.split4(F.col("px"), 8), lambda b: 4 * B.total(b)).alias("dc"))
    r = r.withColumn("qmul", B.array_of(DC_SCALE)[F.col("qp") % 6] * F.pow(F.lit(2), F.floor(F.col("qp") / 6) + 2).cast("int"))
    had = lambda a: F.array(*[sum((a[k] if s > 0 else -a[k] for k, s in enumerate(row)), F.lit(0)) for row in M._H2])
    r = r.withColumn("w", had(F.col("dc"))).withColumn("level", F.transform("w", lambda v: B.clamp(F.rint(v * (F.lit(64.0) / F.col("qmul"))).cast("int"), -2048, 2048)))
    back = F.transform(had(F.col("level")), lambda v: F.floor(v.cast("long") * F.col("qmul") / 256).cast("int"))
    return r.select("vec_id", "level", back.alias("back"))


CHROMA_LEVEL_SQL = f"""SELECT vec_id, level, list_transform({M._H2}, lambda r: CAST((list_sum(list_transform(range(4), lambda i: r[i + 1] * level[i + 1]))::BIGINT * qmul) >> 8 AS INT)) AS back FROM (
  SELECT vec_id, qmul, list_transform({M._H2}, lambda r: CAST(greatest(-2048, least(2048, round_even(list_sum(list_transform(range(4), lambda i: r[i + 1] * dc[i + 1])) * (64.0::DOUBLE / qmul), 0))) AS INT)) AS level FROM (
    SELECT vec_id, {DC_SCALE}[CAST(vec_id % 52 % 6 AS INT) + 1] * (1 << CAST(vec_id % 52 // 6 + 2 AS INT)) AS qmul, list_transform(range(4), lambda k: 4 * CAST(list_sum(list_transform(range(16), lambda i: px[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1])) AS INT)) AS dc FROM ({A.BLOCKS_SQL})))"""


def mode_signal(spark, d):
    """Probable mode of a block from its left and upper neighbour (2 if either is missing), and the bits that tell the mode."""
    r = A.blocks(spark, d).select("vec_id", F.expr("vec_id div 4").alias("mb"), (F.col("vec_id") % 4).cast("int").alias("k"), (F.get("px", F.lit(9)) % 9).alias("mode"))
    w = Window.partitionBy("mb").orderBy("k")
    left, up = F.when(F.col("k") % 2 == 1, F.lag("mode", 1).over(w)), F.when(F.col("k") >= 2, F.lag("mode", 2).over(w))
    r = r.withColumn("probable", F.when(left.isNull() | up.isNull(), 2).otherwise(F.least(left, up)))
    rest = F.col("mode") - F.when(F.col("mode") > F.col("probable"), 1).otherwise(0)
    return r.select("vec_id", "mode", "probable", F.when(F.col("mode") == F.col("probable"), "1").otherwise(F.concat(F.lit("0"), B.bits_of(rest, 3))).alias("bits"))


MODE_SQL = f"""WITH m AS (SELECT vec_id, vec_id // 4 AS mb, CAST(vec_id % 4 AS INT) AS k, px[10] % 9 AS mode FROM ({A.BLOCKS_SQL})),
p AS (SELECT m.vec_id, m.mode, CASE WHEN l.mode IS NULL OR u.mode IS NULL THEN 2 ELSE least(l.mode, u.mode) END AS probable FROM m LEFT JOIN m l ON l.mb = m.mb AND l.k = m.k - 1 AND m.k % 2 = 1 LEFT JOIN m u ON u.mb = m.mb AND u.k = m.k - 2)
SELECT vec_id, mode, probable, CASE WHEN mode = probable THEN '1' ELSE '0' || lpad(bin(mode - CASE WHEN mode > probable THEN 1 ELSE 0 END), 3, '0') END AS bits FROM p"""


def mb_header(spark, d):
    """Type of an intra 16x16 macroblock from mode, chroma and luma patterns, as a code, with trailing bits to the byte."""
    r = S._field(spark, d).select("mb_id", ((F.col("ref") + F.col("qp")) % 4).alias("mode"), (F.col("cbp") % 3).alias("chroma"), (F.col("cbp") % 2).alias("luma"), F.col("intra").alias("in_p"))
    r = r.withColumn("mb_type", 1 + F.col("mode") + 4 * F.col("chroma") + 12 * F.col("luma") + F.when(F.col("in_p"), 5).otherwise(0))
    code = F.concat(B.ue(F.col("mb_type")), F.lit("1"))
    return r.select("mb_id", "mb_type", F.rpad(code, (F.ceil(F.length(code) / 8) * 8).cast("int"), F.lit("0")).alias("bits"))


HEADER_SQL = f"""SELECT mb_id, mb_type, rpad(c, CAST(ceil(length(c) / 8.0) * 8 AS INT), '0') AS bits FROM (SELECT mb_id, mb_type, {S.UE.format(n='mb_type')} || '1' AS c FROM (
  SELECT mb_id, 1 + (ref + qp) % 4 + 4 * (cbp % 3) + 12 * (cbp % 2) + CASE WHEN intra THEN 5 ELSE 0 END AS mb_type FROM ({S.FIELD_SQL})))"""


def capture_formats(spark, d):
    """Formats of each size that can be decoded, largest rate of each, by area. Event types stand for formats, users for devices."""
    e = A.table(spark, d, "events").where(F.col("event_type").isin(*PREFERENCE))
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(F.col("user_id").alias("device"), (k % 5 * 160 + 320).alias("width"), (k % 5 * 90 + 180).alias("height"), "event_type", F.col("value").alias("fps"))
    g = e.groupBy("device", "width", "height").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("formats"), F.max("fps").alias("fps"))
    return g.withColumn("nth", F.row_number().over(Window.partitionBy("device").orderBy(F.col("width") * F.col("height"), "width")))


def capture_choice(spark, d, fps: float = 30.0):
    """The format of a device at 640x360: by preference, then by the nearest rate, then the first offered."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = A.table(spark, d, "events").where(F.col("event_type").isin(*PREFERENCE)).select("user_id", "event_id", "event_type", "value", k.alias("k")).where("k % 5 = 2")
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("event_type"))
    g = e.groupBy(F.col("user_id").alias("device")).agg(F.min(F.struct(rank.alias("r"), F.abs(F.col("value") - fps).alias("far"), "event_id", "event_type")).alias("m"))
    return g.select("device", F.col("m.event_type").alias("format"), F.col("m.event_id").alias("event_id"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
FORMATS_SQL = f"SELECT *, CAST(row_number() OVER (PARTITION BY device ORDER BY width * height, width) AS INT) AS nth FROM (SELECT user_id AS device, {_K} % 5 * 160 + 320 AS width, {_K} % 5 * 90 + 180 AS height, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS formats, max(value) AS fps FROM events WHERE event_type IN {PREFERENCE} GROUP BY 1, 2, 3)"
CHOICE_SQL = f"SELECT device, format, event_id FROM (SELECT user_id AS device, event_type AS format, event_id, row_number() OVER (PARTITION BY user_id ORDER BY list_position({list(PREFERENCE)}, event_type), abs(value - 30.0), event_id) AS r FROM events WHERE event_type IN {PREFERENCE} AND {_K} % 5 = 2) WHERE r = 1"

MB_W, PERIOD = 20, 6
BAND = -(-MB_W // PERIOD)


def refresh_wave(spark, d):
    """Columns refreshed in each frame: a request starts a wave of bands when none runs; an IDR cancels both."""

    def one(s: dict, idr: bool, ask: bool) -> tuple:
        start = end = -1
        if idr:
            s["col"], s["pending"] = -1, False
        else:
            s["pending"] = s["pending"] or ask
            if s["col"] < 0 and s["pending"]:
                s["col"], s["pending"] = 0, False
            if s["col"] >= 0:
                start, end = s["col"], min(s["col"] + BAND, MB_W)
                s["col"] = -1 if end >= MB_W else end
        return start, end

    f = A.feedback(spark, d).select("stream_id", "seq", (F.col("fir") | (F.col("seq") == 0)).alias("idr"), F.col("pli").alias("ask"))
    return folded(f, ["idr", "ask"], "band_start int, band_end int", lambda: {"col": -1, "pending": False}, one, arranged=True)


WAVE_SQL = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT stream_id, seq, fir OR seq = 0 AS idr, pli AS ask FROM ({A.FEEDBACK_SQL})),
r(stream_id, seq, col, pending, s, e) AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT), -1, false, -1, -1 FROM f UNION ALL
  SELECT stream_id, seq, CASE WHEN s < 0 OR s + {BAND} >= {MB_W} THEN -1 ELSE s + {BAND} END, CASE WHEN idr THEN false ELSE p AND NOT (col < 0 AND p) END, s, CASE WHEN s < 0 THEN -1 ELSE least(s + {BAND}, {MB_W}) END FROM (
    SELECT *, CASE WHEN idr THEN -1 WHEN col >= 0 THEN col WHEN p THEN 0 ELSE -1 END AS s FROM (SELECT f.*, r.col, r.pending OR f.ask AS p FROM r JOIN f ON f.stream_id = r.stream_id AND f.seq = r.seq + 1)))
SELECT stream_id, CAST(seq AS INT) AS seq, s AS band_start, e AS band_end FROM r WHERE seq >= 0"""

CATALOG = {
    "q_luma_dc_quant": (luma_dc_quant, f"SELECT mb_id, qp, level FROM ({DC_LEVEL_SQL})"),
    "q_luma_dc_recon": (luma_dc_recon, DC_RECON_SQL),
    "q_chroma_dc_quant": (chroma_dc_levels, CHROMA_LEVEL_SQL),
    "q_mode_signal": (mode_signal, MODE_SQL),
    "q_mb_header": (mb_header, HEADER_SQL),
    "q_capture_formats": (capture_formats, FORMATS_SQL),
    "q_capture_choice": (capture_choice, CHOICE_SQL),
    "q_refresh_wave": (refresh_wave, WAVE_SQL),
}
