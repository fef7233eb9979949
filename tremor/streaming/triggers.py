"""Trigger events over a stream of samples, as session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigger_sessions(stream: DataFrame, threshold: float, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(sensor, start, end, hits, peak): hits nearer than ``gap`` are one event; samples up to ``late`` behind still count."""
    hits = stream.withWatermark("ts", late).where(F.abs("value") >= threshold)
    g = hits.groupBy("sensor", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("hits"), F.max(F.abs("value")).alias("peak"))
    return g.select("sensor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hits", "peak")


def minute_means(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy("sensor", F.window("ts", "1 minute").alias("w")).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return g.select("sensor", F.col("w.start").alias("start"), "mean", "variance")
