"""Contiguous shards of near-equal bytes (built-in functions only).

Rows are ordered by (id, crc32, size) and dealt into ranges; each range gets a running
sum; the totals of the ranges (one row a range) give every range its global offset; the
cut is where the midpoint of a row crosses a multiple of total/shards. The text is
read once and never shuffled: only (id, size, crc32) moves.

A shard differs from total/shards by at most half a row's size at each end.

Defined results: a null text has size 1 and crc32 0, as the empty text; rows of equal id
are ordered by crc32 and size, equal rows follow one another; a null id sorts first; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text: str = "text", n_ranges: int | None = None) -> DataFrame:
    """id_col, size, text_crc32, shard, slot. n_ranges (default: the shuffle partitions) bounds
    what the windows over totals and the broadcasts hold."""
    n_ranges = n_ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    t = F.coalesce(F.col(text), F.lit(""))
    sizes = docs.select(F.col(id_col), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    sizes = written(sizes, "shard-sizes")  # range bounds come from a pass over these columns, not over the texts
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranges = sizes.repartitionByRange(n_ranges, *order).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Written, so that the totals and the rows below see the same ranges.
    local = written(ranges.select("*", F.sum("size").over(w).alias("run"), F.row_number().over(w).cast("long").alias("nth")), "shard-runs")
    # One row a range: at most n_ranges rows, so this window and the broadcast are bounded by a parameter.
    parts = local.groupBy("part").agg(F.max("run").alias("bytes"), F.max("nth").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r0"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = local.join(F.broadcast(offsets), "part").select(
        id_col, "size", "text_crc32",
        F.expr(f"cast((2 * (b0 + run) - size) * {int(n_shards)} div (2 * total) as int)").alias("shard"),
        (F.col("r0") + F.col("nth") - 1).alias("nth"),
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))
