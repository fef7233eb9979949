"""Aggregates over samples and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import scalars as S


def sensor_thresholds(df: DataFrame, x: float = 3.0) -> DataFrame:
    """Mean of the absolute values plus x sample deviations of them, both rounded to six digits."""
    a = F.abs("value")
    g = df.groupBy("sensor").agg(F.round(F.avg(a), 6).alias("mean"), F.round(F.stddev_samp(a), 6).alias("std"))
    return g.withColumn("threshold_x", F.col("mean") + F.round(x * F.col("std"), 6))


def chunk_reduction(df: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    """Mean, population variance and its log, and first and last time, of each ``size`` rows; a last part counts too."""
    g = df.withColumn("chunk", F.floor(F.col("i") / size)).groupBy(*keys, "chunk").agg(F.min_by("ts", "i").alias("start_time"), F.max_by("ts", "i").alias("end_time"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    return g.withColumn("log_variance", S.log_variance(F.col("variance")))


def missing_by_minute(df: DataFrame, day: str, ts: str, value: str) -> DataFrame:
    """Missing and all samples by day and minute of the day; rows without a time don't count."""
    d = df.where(F.col(ts).isNotNull()).groupBy(F.col(day).alias("day"), S.minute_of_day(F.col(ts)).alias("minute"))
    g = d.agg(F.count_if(F.col(value).isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
    f = F.col("missing") / F.col("total")
    return g.withColumn("missing_frac", f).withColumn("status", F.when(f > 0.9, "Failed").when(f > 0.1, "Degraded").otherwise("Working"))


def missing_by_day(minutes: DataFrame) -> DataFrame:
    g = minutes.groupBy("day").agg(F.sum("missing").alias("missing"), F.sum("total").alias("total")).where("total > 0")
    p = 100 * F.col("missing") / F.col("total")
    return g.withColumn("missing_pct", p).withColumn("severity", F.when(p > 10, "red").when(p > 5, "orange").otherwise("green"))


def missing_summary(days: DataFrame, minutes: DataFrame, outage: float = 0.1) -> DataFrame:
    p = F.col("missing_pct")
    d = days.agg(F.count(F.lit(1)).alias("days"), F.avg(p).alias("mean_pct"), F.percentile(p, 0.5).alias("median_pct"), F.max(p).alias("max_pct"), F.min(p).alias("min_pct"), F.count_if(p > 5).alias("over_5"), F.count_if(p > 10).alias("over_10"))
    return d.join(F.broadcast(minutes.agg(F.count_if(F.col("missing_frac") > outage).alias("outages"))))  # one row each


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, n) of equal bins between least and most, the last closed; empty bins have 0."""
    g = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    n = df.where(F.col(value).isNotNull()).join(g, keys).withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = g.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(n, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rmse(a: str, b: str):
    return F.sqrt(F.avg(F.pow(F.col(a) - F.col(b), F.lit(2.0))))


def snr(signal: str, other: str):
    e = F.avg(F.pow(F.col(signal) - F.col(other), F.lit(2.0)))
    return 10 * F.log10(F.try_divide(F.avg(F.col(signal) * F.col(signal)), e))


def line_fit(df: DataFrame, keys: list[str], x: str, t: str) -> DataFrame:
    """t = a + b x by least squares and u = 1/b; null for under two points, one place, or b of zero or less."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept(t, x).alias("a"), F.regr_slope(t, x).alias("b"))
    ok = (F.col("n") >= 2) & (F.col("b") > 0)
    return g.select(*keys, "n", F.when(ok, F.col("a")).alias("a"), F.when(ok, F.try_divide(F.lit(1.0), F.col("b"))).alias("u"))


def compare(a: str, b: str) -> list:
    x, y = F.col(a), F.col(b)
    return [F.avg(F.abs(x - y)).alias("mae"), F.corr(x, y).alias("pearson_corr"), F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("cosine_sim")]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(duplicates): rows beyond the first of each key; null keys equal each other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
