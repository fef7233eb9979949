"""Report tables: statistics of events, traffic and weights, and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.operators import windows as X


def event_statistics(events: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """Number of events and their least, largest, mean and median duration in seconds."""
    d = events.withColumn("_s", (F.col("end_idx") - F.col("start_idx")) * dt)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("shortest"), F.max("_s").alias("longest"), F.avg("_s").alias("mean"), F.percentile("_s", 0.5).alias("median"))


def first_activation(df: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """The first time of each key."""
    return df.groupBy(*keys).agg(F.min(seconds).alias("first_s"))


def range_report(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, std, lo, q1, median, q3, hi) of each column, quartiles on the line between neighbours."""
    d = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "v").where("v is not null")
    q = lambda p: F.percentile("v", p)
    return d.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("v").alias("hi"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, nulls) of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).unpivot([], columns, "name", "nulls")


def differences(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, equal, mean, std, hi, lo) of columns of differences; nulls don't count."""
    d = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "v")
    return d.groupBy("name").agg(F.count_if(F.col("v") == 0).alias("equal"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max("v").alias("hi"), F.min("v").alias("lo"))


def day_statistics(df: DataFrame, value: str, day: str = "date", time: str = "datetime") -> DataFrame:
    """Mean, largest, least, sample deviation and sum of each day, and the first time of its largest and least value."""
    late = lambda c: F.struct(F.col(value).alias("v"), (-F.unix_micros(F.col(c).cast("timestamp"))).alias("n"), F.col(c).alias("t"))
    return df.groupBy(day).agg(F.avg(value).alias("mean"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.stddev_samp(value).alias("std"), F.sum(value).alias("total"), F.max(late(time))["t"].alias("hi_at"), F.min(F.struct(F.col(value).alias("v"), F.col(time).alias("t")))["t"].alias("lo_at"))


def records_per_date(df: DataFrame, day: str = "date") -> DataFrame:
    """(date text, records); dates as day/month/year texts, as the reports order them."""
    return df.groupBy(F.date_format(day, "dd/MM/yyyy").alias("date")).agg(F.count(F.lit(1)).alias("records"))


def date_range(days: DataFrame) -> DataFrame:
    """The number of dates, and the first and last one in the order of their texts."""
    return days.agg(F.count(F.lit(1)).alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


def rows_between(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to before ``last`` in an order: a range sort that keeps ``last`` rows."""
    top = df.orderBy(*order).limit(last)
    return top.withColumn("row", F.row_number().over(X.by([], *order)) - 1).where(F.col("row") >= first)


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value once, with the first place that has it."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def bind_reversed(a: DataFrame, b: DataFrame, keys: list[str], order_a: str, order_b: str) -> DataFrame:
    """The rows of ``a`` in order beside those of ``b`` in reverse, within each key."""
    x = a.withColumn("place", F.row_number().over(X.by(keys, order_a)) - 1)
    y = b.withColumn("place", F.row_number().over(X.by(keys, F.desc(order_b))) - 1)
    return x.join(y, [*keys, "place"])


def isolated_merge(a: DataFrame, b: DataFrame, time: str) -> DataFrame:
    """All times of two tables, with the columns of both."""
    return a.join(b, time, "full_outer")


def vehicle_counts(counts: DataFrame, ranges: DataFrame, columns: list[str], day: bool = True) -> DataFrame:
    """The counts of the first row whose label holds a range's text, and its day's if ``day``; zeros without one.

    ``counts`` are (row, label, ...), the few ``ranges`` are (range_id, range_text, day_text).
    """
    fits = F.col("label").contains(F.col("range_text")) & (F.col("label").contains(F.col("day_text")) if day else F.lit(True))
    found = counts.join(F.broadcast(ranges), fits).groupBy("range_id").agg(F.min(F.struct("row", *columns)).alias("r"))
    return ranges.join(found, "range_id", "left").select("range_id", *(F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c) for c in columns))


# --- traffic ------------------------------------------------------------------


def heavy_patterns(df: DataFrame) -> DataFrame:
    """Sum and mean of heavy vehicles, and trucks among them, by day type."""
    return df.groupBy("day_type").agg(F.sum("heavy").alias("total"), F.avg("heavy").alias("mean"), F.try_divide(F.sum("Truck") * 100.0, F.sum("heavy")).alias("truck_pct"))


def rush_hours(df: DataFrame, value: str) -> DataFrame:
    """Means from 6 to 9 and from 16 to 19 by day type, both ends included."""
    mean = lambda a, b: F.avg(F.when(F.col("hour").between(a, b), F.col(value)))
    return df.groupBy("day_type").agg(mean(6, 9).alias("morning"), mean(16, 19).alias("evening"))


def weekday_profile(df: DataFrame, columns: list[str], weeks: int = 4) -> DataFrame:
    """Sums by day of the week over the number of weeks, Monday 0."""
    return df.groupBy(F.weekday("datetime").cast("long").alias("weekday")).agg(*((F.sum(c) / weeks).alias(c) for c in columns))


def row_shares(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per cent of each column in the sum of its row, by key."""
    g = df.groupBy(key).agg(*(F.sum(c).alias(c) for c in columns))
    total = sum((F.col(c) for c in columns), F.lit(0))
    return g.select(key, *(F.try_divide(F.col(c) * 100.0, total).alias(c) for c in columns))


# --- tables behind plots ------------------------------------------------------


def gaussian_curve(vehicles: DataFrame, places: DataFrame, gate_m: float = -2300.0, points: int = 41, sigmas: float = 4.0) -> DataFrame:
    """(vehicle, sensor, k, t, density): each vehicle's arrival curve at each of the few sensors."""
    d = F.col("pos") - F.lit(gate_m)
    a, b = d / F.col("v_max"), d / F.col("v_min")
    v = vehicles.where("v_min > 0 and v_max > 0").join(F.broadcast(places))
    v = v.withColumns({"mu": F.col("entry") + (a + b) / 2, "sigma": F.greatest((b - a) / 2, F.lit(1e-3))})
    v = v.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    t = F.col("mu") + (F.col("k") * (2 * sigmas / (points - 1)) - sigmas) * F.col("sigma")
    return v.withColumn("t", t).select("vehicle", "sensor", "k", "t", S.gaussian(F.col("t"), F.col("mu"), F.col("sigma")).alias("density"))


def track_lines(tracks: DataFrame, places: DataFrame) -> DataFrame:
    """(track, x, t) of the line of each track at each of the few positions."""
    return tracks.join(F.broadcast(places.select("x").distinct())).select("track", "x", (F.col("a") + F.col("x") / F.col("u")).alias("t"))


def truth_lines(truth: DataFrame, stations: list[float]) -> DataFrame:
    """(vehicle_id, x, t): crossing times, stored as a map from station to time, at known stations."""
    d = truth.select("vehicle_id", F.explode("times").alias("x", "t")).withColumn("x", F.col("x").cast("double"))
    return d.where(F.col("x").isin(stations))


def merge_zoom(claims: DataFrame, gap_s: float) -> DataFrame:
    """The claims of detections that several tracks claim within ``gap_s``: (event_id, track, t_hat, n)."""
    g = claims.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_hat").alias("lo"), F.max("t_hat").alias("hi"))
    return claims.join(g.where((F.col("n") > 1) & (F.col("hi") - F.col("lo") <= gap_s)).select("event_id", "n"), "event_id")


def metric_by_vehicles(spectra: DataFrame, counts: DataFrame, key: str, metric: str) -> DataFrame:
    """(vehicles, n, mean) of a spectral metric by the number of vehicles of its time."""
    d = spectra.join(counts, key)
    return d.groupBy("vehicles").agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))


def coverage(tracks: DataFrame, truth: DataFrame) -> DataFrame:
    """(vehicle, n, hits, best_track, share): the track that holds most of each vehicle's true detections, the first name of equals."""
    own = truth.groupBy("vehicle").agg(F.count(F.lit(1)).alias("n"))
    m = truth.join(tracks.select("track", F.explode("dids").alias("event_id")), "event_id").groupBy("vehicle", "track").agg(F.count(F.lit(1)).alias("hits"))
    best = X.first_rows(m, ["vehicle"], F.desc("hits"), "track")
    d = own.join(best, "vehicle", "left")
    return d.select("vehicle", "n", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.col("track").alias("best_track"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("share"))


def normalised(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Scores over their sum for each key; without a sum they stay."""
    total = F.sum(score).over(X.W.partitionBy(*keys))
    return scores.withColumn(score, F.when(total > 0, F.col(score) / total).otherwise(F.col(score)))


def ambiguous(scores: DataFrame, share: float = 0.8) -> DataFrame:
    """(sensor, event, best, second, ambiguous): whether the second score comes near the best."""
    w = X.by(["sensor", "event"], F.desc("score"), "vehicle")
    d = scores.withColumns({"_n": F.row_number().over(w), "second": F.lead("score").over(w)}).where("_n = 1")
    return d.select("sensor", "event", F.col("score").alias("best"), "second", F.coalesce(F.col("second") >= share * F.col("score"), F.lit(False)).alias("ambiguous"))


def progression_points(scores: DataFrame, least: float = 0.05) -> DataFrame:
    """(vehicle, sensor, event, t, elapsed): events of enough score, with the seconds since the vehicle's first."""
    d = scores.where(F.col("score") >= least)
    first = d.groupBy("vehicle").agg(F.min("t").alias("_t"))
    return d.join(first, "vehicle").select("vehicle", "sensor", "event", "t", (F.col("t") - F.col("_t")).alias("elapsed"))


def longest_track(tracks: DataFrame, rank: int = 1) -> DataFrame:
    """The track of a rank by length, then score and name: a top-k report."""
    d = tracks.withColumn("n", F.size("dids")).orderBy(F.desc("n"), F.desc("score"), "track").limit(rank)
    return d.orderBy("n", "score", F.desc("track")).limit(1)


def unified(scores: DataFrame) -> DataFrame:
    """Propagated scores under common names: the prior is the cumulative score over the best raw one (``best``, if there)."""
    best = F.col("best") if "best" in scores.columns else F.max("score").over(X.W.partitionBy("vehicle", "sensor"))
    return scores.withColumn("prior", F.try_divide(F.col("cumulative"), best)).drop("best").withColumn("bayes", F.col("prior") * F.col("score"))


def by_axis(sensors: DataFrame, column: Column) -> DataFrame:
    """(span, part, n, ids): sensors of each span by axis or side, ids in order of distance; a span has few."""
    d = sensors.withColumn("part", column)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("dist", "sensor_id"))), lambda s: s["sensor_id"].cast("string"))
    return d.groupBy("span", "part").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", ids).alias("ids"))
