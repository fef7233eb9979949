"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Italian day labels, Monday first
DAYS = ["Lun", "Mar", "Mer", "Gio", "Ven", "Sab", "Dom"]
SENSOR_TIME = "yyyy/MM/dd HH:mm:ss:SSS"


def number(c: Column) -> Column:
    """Parse or null: line ends and spaces go, an empty cell is null."""
    return F.nullif(F.trim(F.replace(c, F.lit("\n"), F.lit(""))), F.lit("")).try_cast("double")


def safe_float(c: Column, default: float) -> Column:
    return F.coalesce(number(c), F.lit(default))


def digits(c: Column) -> Column:
    """The number of a text of digits, else -1."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).otherwise(F.lit(-1))


def clock_text(c: Column) -> Column:
    """The first time such as 8:15 in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d{1,2}:\d{2})", 1), F.lit(""))


def date_text(c: Column) -> Column:
    """The first date such as 01/02/2025 in a text, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1), F.lit(""))


def clock_minutes(c: Column) -> Column:
    """Minutes of a text such as 8:15; null if it isn't one."""
    at = lambda k: F.split_part(c, F.lit(":"), F.lit(k)).try_cast("int")
    return F.when(c.contains(":"), at(1) * 60 + at(2))


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws(" vs ", a, b)


def channel(axes: Column, axis: Column) -> Column:
    """The channel of an axis from a struct of the three; null for an unknown axis."""
    return F.when(axis == "vertical", axes["vertical"]).when(axis == "flexural", axes["flexural"]).when(axis == "torsional", axes["torsional"])


def location(span: Column, dist: Column, side: Column) -> Column:
    """The key of a place on the bridge."""
    return F.struct(span.alias("span"), F.round(dist, 6).alias("dist"), side.alias("side"))


def parse_time(c: Column, *formats: str) -> Column:
    """The first format that fits, in order; null if none."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats))


def event_time(c: Column) -> Column:
    """ISO first, then day and month swapped, then day/month/year."""
    return parse_time(c, "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-dd-MM HH:mm:ss[.SSSSSS]", "dd/MM/yyyy HH:mm[:ss]")


def interval_label(c: Column) -> Column:
    """(datetime, day, time) of a label such as 'Sab - 01/02/2025 0:00 - 0:15'."""
    parts = F.split(F.trim(F.replace(c, F.lit("\n"), F.lit(" "))), r"\s+-\s+")
    return F.struct(F.try_to_timestamp(F.get(parts, F.lit(1)), F.lit("dd/MM/yyyy H:mm")).cast("timestamp_ntz").alias("datetime"), F.get(parts, F.lit(0)).alias("day"), F.element_at(F.split(F.get(parts, F.lit(1)), " "), -1).alias("time"))


def day_number(day: Column) -> Column:
    """0 for Monday; null for an unknown label."""
    return F.nullif(F.array_position(F.array(*map(F.lit, DAYS)), day), F.lit(0)) - 1


def day_type(day: Column) -> Column:
    return F.when(day_number(day) >= 5, "Weekend").otherwise("Weekday")


def time_category(hour: Column) -> Column:
    return F.when((hour >= 6) & (hour < 10), "Morning Rush").when((hour >= 10) & (hour < 16), "Midday").when((hour >= 16) & (hour < 20), "Evening Rush").otherwise("Night")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def clock(sec: Column) -> Column:
    """HH:MM:SS.mmm, truncated."""
    ms = F.floor(sec * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def gaussian(x: Column, mu: Column, sigma: Column) -> Column:
    """Unnormalised kernel; a sigma of zero or less counts only the centre."""
    return F.when(sigma > 0, F.exp(-0.5 * F.pow((x - mu) / sigma, F.lit(2.0)))).otherwise(F.when(x == mu, 1.0).otherwise(0.0))


def log_normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    return -0.5 * F.pow((x - mu) / sigma, F.lit(2.0)) - F.log(sigma * F.sqrt(F.lit(2 * 3.141592653589793)))


def log_variance(v: Column) -> Column:
    return F.when(v > 0, F.log(v))


def decibel(v: Column, eps: float = 1e-10) -> Column:
    return 10 * F.log10(v + eps)


def speed_kmh(lag: Column, distance: Column, strict: bool = True) -> Column:
    """Distance over lag; infinite for no lag, and for a negative one if ``strict``."""
    flat = lag <= 0 if strict else lag == 0
    return F.when(flat, F.lit(float("inf"))).otherwise(F.try_divide(distance, lag) * 3.6)


def peak_cell(cell: Column) -> Column:
    """[(ts, amp)] of a cell 'ts|amp;ts|amp'; entries that don't parse are dropped."""
    items = F.filter(F.split(cell, ";"), lambda x: F.trim(x) != "")
    pairs = F.transform(items, lambda x: F.struct(event_time(F.trim(F.split_part(x, F.lit("|"), F.lit(1)))).alias("ts"), F.split_part(x, F.lit("|"), F.lit(2)).try_cast("double").alias("amp")))
    return F.filter(pairs, lambda p: p["ts"].isNotNull())


def literal(c: Column, schema: str) -> Column:
    """A Python list or dict literal as an array or a map."""
    return F.from_json(F.replace(F.replace(c, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null")), schema)
