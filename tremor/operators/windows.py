"""Window helpers over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by(keys: list[str], *order):
    return W.partitionBy(*keys).orderBy(*order)


def centered(width: int) -> tuple[int, int]:
    """Row bounds of a centred window; an even one reaches further back."""
    return (-(width // 2), width // 2 - 1) if width % 2 == 0 else (-(width // 2), width // 2)


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, width: int, centre: bool = False, name: str = "ma") -> DataFrame:
    """A mean over the rows there are, one at least."""
    lo, hi = centered(width) if centre else (1 - width, 0)
    return df.withColumn(name, F.avg(value).over(by(keys, order).rowsBetween(lo, hi)))


def gaps(df: DataFrame, keys: list[str], order: str, ts: str, name: str = "gap") -> DataFrame:
    """Minutes since the row before, in the given order."""
    return df.withColumn(name, F.timestamp_diff("SECOND", F.lag(ts).over(by(keys, order)), F.col(ts)) / 60)


def isolated(df: DataFrame, keys: list[str], ts: str, gap: float) -> DataFrame:
    """Rows whose nearest different times, before and after, are more than ``gap`` minutes away; all equal rows stay."""
    w = by(keys, ts)
    d = df.select(*keys, ts).distinct()
    far = lambda a, b: F.coalesce(F.timestamp_diff("SECOND", a, b) > gap * 60, F.lit(True))
    d = d.withColumns({"_a": F.lag(ts).over(w), "_b": F.lead(ts).over(w)})
    return df.join(d.where(far(F.col("_a"), F.col(ts)) & far(F.col(ts), F.col("_b"))).select(*keys, ts), [*keys, ts], "left_semi")


def first_rows(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(by(keys, *order))).where("_n = 1").drop("_n")


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, name: str = "run") -> DataFrame:
    """Runs of rows with the flag, numbered from 1; other rows go."""
    w = by(keys, order)
    start = (flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    return df.withColumn(name, F.sum(start).over(w)).where(flag)


def gap_islands(df: DataFrame, keys: list[str], order: str, gap: float, name: str = "run", closed: bool = False) -> DataFrame:
    """Groups of rows no further than ``gap`` from the member before; a distance of just ``gap`` parts them if ``closed``."""
    w = by(keys, order)
    d = F.col(order) - F.lag(order).over(w)
    new = F.coalesce((d >= gap) if closed else (d > gap), F.lit(True)).cast("int")
    return df.withColumn(name, F.sum(new).over(w))


def box_smooth(df: DataFrame, keys: list[str], value: str, size: int, name: str = "env") -> DataFrame:
    """A box mean of the absolute value with mirrored borders: an even box covers size/2 before and size/2 - 1 after."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    pad = size // 2
    d = df.withColumn("_n", n).withColumn("_abs", F.abs(value))
    copies = F.array(F.lit(0), F.lit(1), F.lit(2))
    d = d.withColumn("_copy", F.explode(F.filter(copies, lambda c: (c == 0) | ((c == 1) & (F.col("i") < pad)) | ((c == 2) & (F.col("i") >= F.col("_n") - pad)))))
    at = F.when(F.col("_copy") == 0, F.col("i")).when(F.col("_copy") == 1, -F.col("i") - 1).otherwise(2 * F.col("_n") - F.col("i") - 1)
    lo = -(size // 2)
    d = d.withColumn("_at", at).withColumn(name, F.avg("_abs").over(by(keys, "_at").rowsBetween(lo, lo + size - 1)))
    return d.where("_copy = 0").drop("_n", "_abs", "_copy", "_at")


def rms_envelope(df: DataFrame, keys: list[str], value: str, width: int, name: str = "rms") -> DataFrame:
    """Root mean square of each row and the ``width - 1`` after it, whole windows only."""
    w = by(keys, "i").rowsBetween(0, width - 1)
    d = df.withColumn(name, F.sqrt(F.avg(F.col(value) * F.col(value)).over(w))).withColumn("_c", F.count(F.lit(1)).over(w))
    return d.where(F.col("_c") == width).drop("_c")


def zero_crossings(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, zcr): changes of sign, zero a sign of its own, over the number of samples."""
    s = F.signum(value)
    d = df.withColumn("_x", (s != F.lag(s).over(by(keys, "i"))).cast("int"))
    return d.groupBy(*keys).agg((F.coalesce(F.sum("_x"), F.lit(0)) / F.count(F.lit(1))).alias("zcr"))


def interpolate(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill nulls on the line between the known neighbours, or with the only one."""
    before, after = by(keys, "i").rowsBetween(W.unboundedPreceding, 0), by(keys, "i").rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct("i", value))
    a, b = F.last(known, True).over(before), F.first(known, True).over(after)
    line = a[value] + (b[value] - a[value]) * F.try_divide(F.col("i") - a["i"], b["i"] - a["i"])
    return df.withColumn("_f", F.coalesce(F.col(value), line, a[value], b[value])).withColumn(value, F.col("_f")).drop("_f")
