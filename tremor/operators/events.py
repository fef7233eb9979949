"""Event detection: masks, runs, triggers, envelopes, peaks.  All in windows, none in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.operators import windows as X


def activity_mask(df: DataFrame, keys: list[str], threshold: Column, span: int, pre: int = 0, name: str = "active") -> DataFrame:
    """Active from ``pre`` rows before a hit (a value of at least the threshold) to ``span - 1`` after it."""
    hit = (F.abs("value") >= threshold).cast("int")
    return df.withColumn(name, F.max(hit).over(X.by(keys, "i").rowsBetween(1 - span, pre)) == 1)


def threshold_filter(df: DataFrame, keys: list[str], threshold: Column, span: int) -> DataFrame:
    """The value where active, else 0, as ``filtered``."""
    return activity_mask(df, keys, threshold, span).withColumn("filtered", F.when(F.col("active"), F.col("value")).otherwise(0.0))


def threshold_sweep(df: DataFrame, keys: list[str], thresholds: list[float], span: int) -> DataFrame:
    """(keys, threshold, rmse, retained) for each threshold; every row is read once and copied for each."""
    d = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    d = threshold_filter(d, [*keys, "threshold"], F.col("threshold"), span)
    return d.groupBy(*keys, "threshold").agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("filtered"), F.lit(2.0)))).alias("rmse"), F.avg(F.col("active").cast("int")).alias("retained"))


def runs(df: DataFrame, keys: list[str], flag: Column = F.col) -> DataFrame:
    """(keys, run, start_idx, end_idx): active runs, the end excluded."""
    return X.islands(df, keys, "i", F.col("active")).groupBy(*keys, "run").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx"))


def moments(value: str = "value") -> list[Column]:
    """Statistics of an event's samples; deviation, skew and kurtosis are of the population."""
    v = F.col(value)
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.sum(v * v).alias("energy"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")]


def event_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    return X.islands(df, keys, "i", F.col("active")).groupBy(*keys, "run").agg(F.min("i").alias("start_idx"), (F.max("i") + 1).alias("end_idx"), F.count(F.lit(1)).alias("n"), *moments())


def peaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run, first_idx, first_value, peak_idx, peak_value) of each active run.

    Extrema are interior rows no smaller, or no larger, than both neighbours,
    and the first row if it leads away from zero; a run without any takes its
    largest absolute value.  Equals go to the earliest.
    """
    d = X.islands(df, keys, "i", F.col("active"))
    w = X.by([*keys, "run"], "i")
    v, a, b = F.col("value"), F.lag("value").over(w), F.lead("value").over(w)
    edge = a.isNull() & (((v > 0) & (v > b)) | ((v < 0) & (v < b)))
    inner = ((v >= a) & (v >= b)) | ((v <= a) & (v <= b))
    d = d.withColumn("_e", F.coalesce(edge | inner, F.lit(False)))
    big = F.struct(F.abs("value").alias("m"), (-F.col("i")).alias("n"), F.col("value").alias("v"))
    g = d.groupBy(*keys, "run").agg(F.min(F.when(F.col("_e"), F.struct("i", "value"))).alias("f"), F.max(F.when(F.col("_e"), big)).alias("p"), F.max(big).alias("q"))
    p = F.coalesce("p", "q")
    return g.select(*keys, "run", F.coalesce(F.col("f.i"), -p["n"]).alias("first_idx"), F.coalesce(F.col("f.value"), p["v"]).alias("first_value"), (-p["n"]).alias("peak_idx"), p["v"].alias("peak_value"))


def triggers(df: DataFrame, keys: list[str], threshold: float, width: int, pre: int) -> DataFrame:
    """(keys, event, start_idx, end_idx, n_triggers): a hit at least ``width`` after the hit before opens an event.

    A hit that doesn't move the end (at the signal's end) is no trigger.
    """
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hits = X.gap_islands(df.where(F.abs("value") >= threshold), keys, "i", width, "event", closed=True).join(size, keys)
    w = X.by([*keys, "event"], "i")
    before = F.lag("i").over(w)
    moves = before.isNull() | (F.least(F.col("i") + width, F.col("_n")) > F.least(before + width, F.col("_n")))
    g = hits.withColumn("_m", moves.cast("int")).groupBy(*keys, "event").agg(F.greatest(F.min("i") - pre, F.lit(0)).alias("start_idx"), F.max(F.least(F.col("i") + width, F.col("_n"))).alias("end_idx"), F.sum("_m").alias("n_triggers"))
    return g


def samples_of(events: DataFrame, df: DataFrame, keys: list[str], bin_rows: int = 4096) -> DataFrame:
    """Each event's samples by an equi-join on bins of rows, so a long signal is dealt over many tasks."""
    e = events.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_idx") / bin_rows), F.floor((F.col("end_idx") - 1) / bin_rows))))
    s = df.select(*keys, "i", "value").withColumn("_bin", F.floor(F.col("i") / bin_rows))
    return e.join(s, [*keys, "_bin"]).where("i >= start_idx and i < end_idx").drop("_bin")


def event_features(events: DataFrame, df: DataFrame, keys: list[str], dt: float, least: int = 0, most: int = 1 << 60) -> DataFrame:
    """Events of fitting length with their peak (earliest of equals) and energy."""
    ok = events.where((F.col("end_idx") - F.col("start_idx")).between(least, most))
    g = samples_of(ok, df, keys).groupBy(*events.columns).agg(F.max(F.struct(F.abs("value").alias("m"), (-F.col("i")).alias("n"), F.col("value").alias("v"))).alias("p"), (F.sum(F.abs("value")) * dt).alias("energy"))
    return g.select(*events.columns, (-F.col("p.n")).alias("peak_idx"), F.col("p.v").alias("peak_value"), "energy")


def envelope_events(df: DataFrame, keys: list[str], size: int, merge: int, least: int, percentile: float | None = 0.85, sigmas: float = 3.0, strict: bool = False) -> DataFrame:
    """Runs of the smoothed envelope over a threshold, joined over small gaps, of some length.

    The threshold is a percentile, or the mean and ``sigmas`` deviations of the
    envelope without one.  Runs join at a gap of up to ``merge``, or under it if ``strict``.
    """
    env = X.box_smooth(df, keys, "value", size)
    level = F.percentile("env", percentile) if percentile is not None else F.avg("env") + sigmas * F.stddev_pop("env")
    # one row for each signal
    d = env.join(env.groupBy(*keys).agg(level.alias("level")), keys).withColumn("active", F.col("env") > F.col("level"))
    r = runs(d, keys)
    w = X.by(keys, "start_idx")
    gap = F.col("start_idx") - F.lag("end_idx").over(w)
    new = F.coalesce((gap >= merge) if strict else (gap > merge), F.lit(True)).cast("int")
    r = r.withColumn("event", F.sum(new).over(w)).groupBy(*keys, "event").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    return r.where(F.col("end_idx") - F.col("start_idx") >= least)


def boundary_events(wim: DataFrame, samples: DataFrame, offset_min: float = 1.5, window_min: float = 5.0) -> DataFrame:
    """(vehicle_id, sensor, i, ts, value): each vehicle's samples, centred within its window.

    Both sides are dealt by hour, and a vehicle is copied to each hour of its window.
    """
    a = F.timestamp_add("SECOND", F.lit(int(offset_min * 60)), F.col("start_ts"))
    b = F.timestamp_add("SECOND", F.lit(int((offset_min + window_min) * 60)), F.col("start_ts"))
    v = wim.withColumns({"_a": a, "_b": b})
    v = v.withColumn("_h", F.explode(F.sequence(F.date_trunc("hour", "_a"), F.date_trunc("hour", "_b"), F.expr("interval 1 hour"))))
    d = samples.withColumn("_h", F.date_trunc("hour", "ts")).join(v, "_h").where("ts between _a and _b")
    d = d.withColumn("value", F.col("value") - F.avg("value").over(W.partitionBy("vehicle_id", "sensor")))
    d = d.withColumn("i", F.row_number().over(W.partitionBy("vehicle_id", "sensor").orderBy("ts")) - 1)
    return d.select("vehicle_id", "sensor", "i", "ts", "value")


def progression(points: DataFrame) -> DataFrame:
    """Seconds of each peak since the vehicle's first peak; points are (vehicle_id, sensor, first_ts, peak_ts)."""
    return points.withColumn("elapsed", F.timestamp_diff("MICROSECOND", F.min("first_ts").over(W.partitionBy("vehicle_id")), F.col("peak_ts")) / 1e6)
