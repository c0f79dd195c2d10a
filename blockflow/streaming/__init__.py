"""Streaming jobs: keyed control state, and the newest feedback of each interval under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockflow.operators.control import Config, stream_decisions

__all__ = ["Config", "newest_feedback", "stream_decisions"]


def newest_feedback(feedback: DataFrame, interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """stream_id, start, seq, rtt_ms, dropped: of each stream and interval (column ts) the row of largest seq, and how many gave way.

    State is one row a stream and open interval; rows later than `late` are ignored.
    """
    g = feedback.withWatermark("ts", late).groupBy("stream_id", F.window("ts", interval).alias("w"))
    best = g.agg(F.max(F.struct("seq", "rtt_ms")).alias("m"), (F.count(F.lit(1)) - 1).alias("dropped"))
    return best.select("stream_id", F.col("w.start").alias("start"), F.col("m.seq").alias("seq"), F.col("m.rtt_ms").alias("rtt_ms"), "dropped")
