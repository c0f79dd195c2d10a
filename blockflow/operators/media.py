"""Files of frames and units: written by the sinks of blockflow.sources and read back from byte ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.operators import entropy as E
from blockflow.sources import adapters as A
from blockflow.sources import bytestream
from blockflow.sources.rawvideo import RawVideo

#: Frames of text: 32x16, 512 bytes of luma and 128 of each chroma plane.
TEXT_WIDTH, TEXT_HEIGHT, TEXT_BYTES = 32, 16, 768


def shared(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, deleted when the driver ends. A cluster names its place in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/media-{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def text_frames(spark, d) -> DataFrame:
    """y, u, v: the bytes of every text as pictures of 32x16, the last one filled with zeros."""
    t = A.table(spark, d, "documents").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b")).where("octet_length(b) > 0")
    t = t.select("b", F.explode(F.expr(f"sequence(0, (octet_length(b) - 1) div {TEXT_BYTES})")).alias("k"))
    t = t.select(F.expr(f"rpad(substring(b, k * {TEXT_BYTES} + 1, {TEXT_BYTES}), {TEXT_BYTES}, X'00')").alias("b"))
    return t.select(*[F.expr(f"substring(b, {at}, {n})").alias(p) for p, at, n in (("y", 1, 512), ("u", 513, 128), ("v", 641, 128))])


def raw_frames(spark, d):
    """Frames of two sizes, one with padded lines, written as raw video and read back in ranges of a few frames: how often each frame came back."""
    spark.dataSource.register(RawVideo)
    out = []
    for rows, options in (
        (text_frames(spark, d), {"width": TEXT_WIDTH, "height": TEXT_HEIGHT}),
        (A.pictures(spark, d).select("y", "u", "v"), {"width": 48, "height": 32, "stride": 64, "chroma_stride": 37}),
    ):
        path = shared(spark, "frames")
        rows.write.format("rawvideo").options(**options).mode("overwrite").save(path)
        out.append(spark.read.format("rawvideo").options(**options, partition_bytes=1 << 22).load(path))
    rows = out[0].union(out[1])
    return rows.groupBy("width", "height", *[F.md5(p).alias(f"{p}_md5") for p in "yuv"]).agg(F.count("*").alias("n"))


_DATA = "unhex(array_to_string(list_transform({}, lambda v: lpad(hex(v), 2, '0')), ''))"
RAW_SQL = f"""SELECT width, height, y_md5, u_md5, v_md5, count(*) AS n FROM (
  SELECT 48 AS width, 32 AS height, md5({_DATA.format('y')}) AS y_md5, md5({_DATA.format('u')}) AS u_md5, md5({_DATA.format('v')}) AS v_md5 FROM ({A.PICTURES_SQL})
  UNION ALL SELECT {TEXT_WIDTH}, {TEXT_HEIGHT}, md5(unhex(substr(x, 1, 1024))), md5(unhex(substr(x, 1025, 256))), md5(unhex(substr(x, 1281, 256)))
  FROM (SELECT rpad(substr(h, CAST(k * 1536 + 1 AS BIGINT), 1536), 1536, '0') AS x FROM (SELECT h, unnest(range(0, CAST((length(h) + 1535) // 1536 AS BIGINT))) AS k FROM (SELECT hex(encode(coalesce(text, ''))) AS h FROM documents)))) GROUP BY ALL"""


def unit_stream(spark, d):
    """Parameter sets and recovery points as eight byte streams, written by stream and read back in ranges that cut units: place, kind and content of each unit."""
    order = F.element_at(F.create_map(F.lit("sps"), F.lit(0), F.lit("pps"), F.lit(1), F.lit("sei"), F.lit(2)), F.col("kind"))
    rows = E.parameter_sets(spark, d).select((F.col("id") % 8).alias("stream_id"), (F.col("id") * 3 + order).alias("seq"), F.unhex("unit").alias("unit"))
    path = shared(spark, "units")
    bytestream.save_streams(rows, path)
    found = spark.read.format("annexb").option("partition_bytes", 1 << 16).load(path)
    stream = F.regexp_extract("path", r"([0-9]+)\.h264$", 1).cast("long")
    return found.select(stream.alias("stream_id"), "offset", "code_length", "length", "ref_idc", "type", F.md5("payload").alias("payload_md5"))


UNITS_SQL = f"""SELECT id % 8 AS stream_id, CAST(sum(n) OVER w - n + 4 AS BIGINT) AS offset, 4 AS code_length, n - 4 AS length, CAST(('0x' || substr(unit, 9, 2))::INT >> 5 & 3 AS INT) AS ref_idc, CAST(('0x' || substr(unit, 9, 2))::INT & 31 AS INT) AS type, md5(unhex(substr(unit, 11))) AS payload_md5
FROM (SELECT id, unit, CAST(length(unit) // 2 AS BIGINT) AS n, CASE kind WHEN 'sps' THEN 0 WHEN 'pps' THEN 1 ELSE 2 END AS k FROM ({E.PARAMETER_SQL})) WINDOW w AS (PARTITION BY id % 8 ORDER BY id, k)"""

CATALOG = {
    "q_raw_frames": (raw_frames, RAW_SQL),
    "q_unit_stream": (unit_stream, UNITS_SQL),
}
