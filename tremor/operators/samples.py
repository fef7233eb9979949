"""Samples of channels in long form: (sensor, i, ts, value).

``keys`` name a signal: a channel and, for data of any length, its file or
hour, so that no window holds more than a file.  ``i`` counts from 0 in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions import scalars as S

TIME_NAMES = ["time", "timestamp", "date"]


def time_column(df: DataFrame, names: list[str] = TIME_NAMES) -> str:
    found = next((c for n in names for c in df.columns if c.lower() == n), None)
    if not found:
        raise ValueError(f"no time column among {df.columns}")
    return found


def sensors(df: DataFrame, wanted: str | None = None) -> list[str]:
    """The channels of a wide table, or those of a comma list; unknown ones are an error."""
    own = [c for c in df.columns if c != time_column(df)]
    if not wanted:
        return own
    ask = [x.strip() for x in wanted.split(",") if x.strip()]
    if wrong := [x for x in ask if x not in own]:
        raise ValueError(f"unknown sensors: {', '.join(wrong)}")
    return ask


def to_long(df: DataFrame, channels: list[str], keep: list[str] = ()) -> DataFrame:
    """Wide to long; times that don't parse and null values go."""
    t = time_column(df)
    ts = F.col(t) if dict(df.dtypes)[t].startswith("timestamp") else S.parse_time(F.col(t), S.SENSOR_TIME, "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    out = df.withColumn("ts", ts).where("ts is not null").unpivot(["ts", *keep], channels, "sensor", "value")
    return out.where("value is not null")


def index(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def remove_dc(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Subtract the mean of each group of ``keys``: the scope of the mean is the caller's choice."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(*keys)))


def normalise(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean 0 and population deviation 1; a flat signal is only centred."""
    by = W.partitionBy(*keys)
    c, d = F.col(value) - F.avg(value).over(by), F.stddev_pop(value).over(by)
    return df.withColumn(value, F.when(d > 1e-10, c / d).otherwise(c))


def between(df: DataFrame, start, minutes: float, ts: str = "ts", closed: bool = True) -> DataFrame:
    """The rows of a time window, its end included if ``closed``."""
    a = F.lit(start).cast("timestamp_ntz")
    b = F.timestamp_add("SECOND", F.lit(int(minutes * 60)), a)
    return df.where((F.col(ts) >= a) & ((F.col(ts) <= b) if closed else (F.col(ts) < b)))


def decimate(df: DataFrame, every: int) -> DataFrame:
    return df.where(F.col("i") % every == 0)


def noise(value: Column, threshold: Column) -> Column:
    return F.abs(value) <= threshold


def signal(value: Column, threshold: Column) -> Column:
    return F.abs(value) > threshold
