"""Test tables as blocks, macroblocks, feedback streams, motion planes and bytes.

Each adapter reads only the columns it maps; the SQL twins are what an oracle starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockflow.functions.folds import dealt

#: Adapter frame: 3 x 2 macroblocks.
MBS_PER_FRAME, MB_COLS = 6, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, px: one 8x8 block of samples for each vector."""
    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256) + 128)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", px.alias("px"))


BLOCKS_SQL = "SELECT vec_id, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(CAST(e AS DOUBLE) * 256) + 128)) AS INT)) AS px FROM embeddings"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, a, b: a block and its successor; an equi-join, so no global order is needed."""
    b = blocks(spark, sf_dir)
    return b.select("vec_id", F.col("px").alias("a")).join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("b")), "vec_id")


PAIRS_SQL = f"SELECT x.vec_id, x.px AS a, y.px AS b FROM ({BLOCKS_SQL}) x JOIN ({BLOCKS_SQL}) y ON y.vec_id = x.vec_id + 1"


def residuals4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, blk, res, qp: 4x4 residuals of successive blocks, with a QP for each."""
    from blockflow.functions.blocks import residual, split4

    rows = pairs(spark, sf_dir).select("vec_id", F.posexplode(split4(residual(F.col("a"), F.col("b")), 8)).alias("blk", "res"))
    return rows.withColumn("qp", ((F.col("vec_id") * 4 + F.col("blk")) % 52).cast("int"))


RESIDUALS4_SQL = f"""SELECT vec_id, k AS blk, CAST((vec_id * 4 + k) % 52 AS INT) AS qp,
  list_transform(range(16), lambda i: a[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1] - b[((k // 2) * 4 + i // 4) * 8 + (k % 2) * 4 + i % 4 + 1]) AS res
  FROM ({PAIRS_SQL}), (SELECT unnest(range(4)) AS k)"""


def macroblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mb_id, frame_idx, mb_idx, parts: four 8x8 blocks; incomplete macroblocks are left out."""
    rows = blocks(spark, sf_dir).groupBy(F.expr("vec_id div 4").alias("mb_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("vec_id") % 4).alias("k"), "px"))).alias("q"))
    rows = rows.where(F.size("q") == 4).select("mb_id", F.expr(f"mb_id div {MBS_PER_FRAME}").alias("frame_idx"), (F.col("mb_id") % MBS_PER_FRAME).cast("int").alias("mb_idx"), F.transform("q", lambda s: s["px"]).alias("parts"))
    return rows


MACROBLOCKS_SQL = f"""SELECT vec_id // 4 AS mb_id, vec_id // 4 // {MBS_PER_FRAME} AS frame_idx, CAST(vec_id // 4 % {MBS_PER_FRAME} AS INT) AS mb_idx,
  flatten(list(px ORDER BY vec_id)) AS px FROM ({BLOCKS_SQL}) GROUP BY vec_id // 4 HAVING count(*) = 4"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback stream a user, adversarial rather than realistic."""
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = dealt(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", k.alias("k")), "user_id")
    return e.select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).alias("seq"), F.col("value").alias("rtt_ms"), (F.col("value") / 8).alias("jitter_ms"),
        F.expr("k / 1000.0D").alias("loss"), (F.col("k") * 1500).alias("queue_bytes"), (F.col("k") % 8).alias("nacks"),
        F.expr("event_type = 'error' AND k < 50").alias("pli"), F.expr("event_type = 'signup' AND k < 30").alias("fir"),
        F.expr("CASE WHEN event_type = 'purchase' THEN k * 100000 ELSE 0 END").alias("estimate_bps"),
        F.expr("CASE WHEN event_type = 'view' THEN value / 4 END").alias("decode_ms"), F.expr("event_type = 'click' AND k < 10").alias("scene_change"),
        F.expr("k / 4.0D").alias("encode_ms"), (F.col("k") * 2500).alias("last_bytes"),
    )


FEEDBACK_SQL = """SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS rtt_ms, value / 8 AS jitter_ms,
  k / 1000.0::double AS loss, k * 1500 AS queue_bytes, k % 8 AS nacks, event_type = 'error' AND k < 50 AS pli, event_type = 'signup' AND k < 30 AS fir,
  CASE WHEN event_type = 'purchase' THEN k * 100000 ELSE 0 END AS estimate_bps, CASE WHEN event_type = 'view' THEN value / 4 END AS decode_ms,
  event_type = 'click' AND k < 10 AS scene_change, k / 4.0::double AS encode_ms, k * 2500 AS last_bytes
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

LUMA = "(((x + 3 * f) * 7 + (y + f) * 13 + ((((x + 3 * f) {div} 5) * ((y + f) {div} 3)) % 47) * 3) & 255)"


PLANE_WIDTH, PLANE_HEIGHT = 48, 32


def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f: the number of every frame, once. A number becomes a plane in the task it is dealt to."""
    return dealt(table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 24").alias("f")), "f").distinct()


def frames(spark: SparkSession, sf_dir: str, width: int = PLANE_WIDTH, height: int = PLANE_HEIGHT) -> DataFrame:
    """frame_idx, px, width, height: a generated plane (bytes in raster order) for every 24 vectors, whose content moves by (3, 1) a frame."""
    f = frame_numbers(spark, sf_dir)
    px = F.expr(f"transform(sequence(0, {width * height - 1}), i -> char(cast({LUMA.format(div='div').replace('x', f'(i % {width})').replace('y', f'(i div {width})')} as int)))")
    return f.select(F.col("f").alias("frame_idx"), F.encode(F.array_join(px, ""), "ISO-8859-1").alias("px"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def planes(spark: SparkSession, sf_dir: str, width: int = PLANE_WIDTH, height: int = PLANE_HEIGHT) -> DataFrame:
    """The same as a row a sample: frame_idx, y, x, v."""
    f = frame_numbers(spark, sf_dir)
    rows = f.select("f", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i")).selectExpr("f", f"cast(i div {width} as int) AS y", f"cast(i % {width} as int) AS x")
    return rows.select(F.col("f").alias("frame_idx"), "y", "x", F.expr(f"cast({LUMA.format(div='div')} as int)").alias("v"))


def planes_sql(width: int = PLANE_WIDTH, height: int = PLANE_HEIGHT) -> str:
    return f"SELECT f AS frame_idx, y, x, CAST({LUMA.format(div='//')} AS INT) AS v FROM (SELECT DISTINCT vec_id // 24 AS f FROM embeddings), (SELECT CAST(unnest(range({height})) AS INT) AS y), (SELECT CAST(unnest(range({width})) AS INT) AS x)"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, width, height, y, u, v: the vectors of six macroblocks as a picture of 48x32; chroma is luma at half size, and its complement."""
    f = macroblocks(spark, sf_dir).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("mb_idx", "parts"))).alias("m")).where(F.size("m") == MBS_PER_FRAME)
    place = lambda r, c: f"m[{MB_COLS} * ({r} div 16) + {c} div 16].parts[({r} % 16 div 8) * 2 + {c} % 16 div 8][({r} % 8) * 8 + {c} % 8]"
    luma = F.expr(f"transform(sequence(0, 1535), i -> {place('(i div 48)', '(i % 48)')})")
    half = F.expr("transform(sequence(0, 383), i -> (y[(i div 24) * 96 + i % 24 * 2] + y[(i div 24) * 96 + i % 24 * 2 + 1] + y[(i div 24) * 96 + i % 24 * 2 + 48] + y[(i div 24) * 96 + i % 24 * 2 + 49] + 2) div 4)")
    data = lambda a: F.encode(F.array_join(F.transform(a, lambda v: F.char(v)), ""), "ISO-8859-1")
    f = f.select("frame_idx", luma.alias("y")).withColumn("u", half)
    return f.select("frame_idx", F.lit(48).alias("width"), F.lit(32).alias("height"), data(F.col("y")).alias("y"), data(F.col("u")).alias("u"), data(F.transform("u", lambda v: 255 - v)).alias("v"))


PICTURES_SQL = f"""SELECT frame_idx, y, u, list_transform(u, lambda v: 255 - v) AS v FROM (SELECT frame_idx, y, list_transform(range(384), lambda i: (y[(i // 24) * 96 + i % 24 * 2 + 1] + y[(i // 24) * 96 + i % 24 * 2 + 2] + y[(i // 24) * 96 + i % 24 * 2 + 49] + y[(i // 24) * 96 + i % 24 * 2 + 50] + 2) // 4) AS u
  FROM (SELECT frame_idx, list_transform(range(1536), lambda i: m[{MB_COLS} * (i // 48 // 16) + i % 48 // 16 + 1][(i // 48 % 16 // 8 * 2 + i % 48 % 16 // 8) * 64 + (i // 48 % 8) * 8 + i % 48 % 8 + 1]) AS y
  FROM (SELECT frame_idx, list(px ORDER BY mb_idx) AS m FROM ({MACROBLOCKS_SQL}) GROUP BY frame_idx HAVING count(*) = {MBS_PER_FRAME})))"""
