"""Quarter-hour traffic counts and weigh-in-motion records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import scalars as S

# fixed values: load weights of the vehicle classes
LOAD = {"Car": 1.0, "Motorbike": 0.5, "Van": 1.5, "Bus": 3.0, "Truck": 5.0}


def clean(df: DataFrame, label: str, counts: list[str], total: str | None = None, null_total: bool = False) -> DataFrame:
    """Label to time and day, cells to integers (null is 0); the lanes' total is null if a lane is, as ``null_total``."""
    raw = {c: S.number(F.col(f"`{c}`")) for c in counts}
    zero = {c: F.coalesce(v, F.lit(0)).cast("int") for c, v in raw.items()}
    p = S.interval_label(F.col(f"`{label}`"))
    out = df.select(p["datetime"].alias("datetime"), p["day"].alias("day"), *(zero[c].alias(c) for c in counts), *([sum((raw if null_total else zero).values(), F.lit(0)).cast("int").alias(total)] if total else []))
    return out


def temporal(df: DataFrame) -> DataFrame:
    """Date, hour, and the day type (by the label) and time category."""
    h = F.hour("datetime")
    return df.withColumns({"date": F.to_date("datetime"), "hour": h, "day_type": S.day_type(F.col("day")), "time_category": S.time_category(h)})


def merge(classes: DataFrame, lanes: DataFrame, transits: DataFrame) -> DataFrame:
    """Full outer joins on the time, null times matching each other, with the discrepancies of the totals."""
    def full(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("datetime", "_d")
        return a.join(b, a.datetime.eqNullSafe(b._d), "full_outer").withColumn("datetime", F.coalesce("datetime", "_d")).drop("_d")

    m = full(full(classes, lanes), transits)
    return m.withColumns({"classi_corsie": F.col("total_classi") - F.col("total_lanes"), "classi_transiti": F.col("total_classi") - F.col("transits")})


def load_columns(df: DataFrame) -> DataFrame:
    heavy, total = F.col("Truck") + F.col("Bus"), sum((F.col(c) for c in LOAD), F.lit(0))
    return df.withColumns({"heavy": heavy, "load_index": sum((F.col(c) * w for c, w in LOAD.items()), F.lit(0.0)), "heavy_pct": F.try_divide(heavy * 100.0, total), "stress_score": heavy * total})


def daily(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("date").agg(F.sum(value).alias("total"))


def extremes(days: DataFrame) -> DataFrame:
    """Mean, least and most day; the first date of equals."""
    return days.agg(F.avg("total").alias("mean"), F.min(F.struct("total", "date")).alias("lo"), F.max(F.struct("total", (-F.unix_date("date")).alias("n"))).alias("hi")).select("mean", F.col("lo.total").alias("min_total"), F.col("lo.date").alias("min_date"), F.col("hi.total").alias("max_total"), F.date_from_unix_date(-F.col("hi.n")).alias("max_date"))


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, total, pct), one row for each column."""
    s = df.agg(*(F.sum(c).alias(c) for c in columns)).unpivot([], columns, "name", "total")
    return s.join(F.broadcast(s.agg(F.sum("total").alias("_t")))).select("name", "total", (F.try_divide(F.col("total") * 100.0, F.col("_t"))).alias("pct"))


def peak_hours(df: DataFrame, value: str, most: int = 5) -> DataFrame:
    """The busiest hours of each day type by mean; the earlier of equals first."""
    from tremor.operators import windows as X

    g = df.groupBy("day_type", "hour").agg(F.avg(value).alias("mean"))
    return g.withColumn("rank", F.row_number().over(X.by(["day_type"], F.desc("mean"), "hour"))).where(F.col("rank") <= most)


def isolated_gaps(df: DataFrame, gap: str, least: float, most: float = 1000.0) -> DataFrame:
    return df.where(F.col(gap).between(least, most))


def wim(df: DataFrame) -> DataFrame:
    """Momentum, and the speed band around each speed in m/s; rows without a speed go."""
    v = F.col("velocity") / 3.6
    return df.where("velocity is not null").withColumns({"momentum": F.col("weight") * F.col("velocity"), "v_est": v, "v_min": v - 10 / 3.6, "v_max": v + 10 / 3.6})
