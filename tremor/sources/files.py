"""Files: wide CSV and Parquet samples, spreadsheets, bridge tables, peak tables; and the sinks."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from tremor.functions import scalars as S
from tremor.operators import windows as X

HOURLY = r"M001_(\d{4}-\d{2}-\d{2})_(\d{2})-00-00_.*_int-(\d+)_th\.csv$"


def read_samples(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A wide sample table by its ending; a CSV is separated by ';'.  Only the asked columns are read."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith((".csv", "/")) or "*" in path:
        df = spark.read.option("sep", ";").option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
        first = df.columns[0]
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
        df = df.select(*(F.col(f"`{c}`") if c.lower() in ("time", "timestamp", "date") else F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns))
    else:
        raise ValueError(f"neither CSV nor Parquet: {path}")
    return df.select(*columns) if columns else df


def hourly(df: DataFrame) -> DataFrame:
    """``date`` and ``hour`` from each row's file name, for data that has them in no column."""
    name = F.col("_metadata.file_name")
    return df.select("*", F.to_date(F.nullif(F.regexp_extract(name, HOURLY, 1), F.lit(""))).alias("date"), F.nullif(F.regexp_extract(name, HOURLY, 2), F.lit("")).cast("int").alias("hour"))


def hour_glob(root: str, date: str, hour: int) -> list[str]:
    """Both folder layouts of an hour's file, as globs for ``spark.read``."""
    day, name = date.replace("-", ""), f"M001_{date}_{hour:02d}-00-00_*_int-{hour + 1}_th.csv"
    return [f"{root}/{day}/{day}/csv_acc/{name}", f"{root}/{day}/csv_acc/{name}"]


def date_hour(name):
    """YYYYMMDD_HH of a file name, or the name without its ending."""
    m = r"(\d{4})-(\d{2})-(\d{2})_(\d{2})"
    return F.when(name.rlike(m), F.concat(F.regexp_extract(name, m, 1), F.regexp_extract(name, m, 2), F.regexp_extract(name, m, 3), F.lit("_"), F.regexp_extract(name, m, 4))).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_peaks(df: DataFrame) -> DataFrame:
    """(vehicle_id, sensor, ts, amp) of a wide peak table; the date is the row's, the time of day the peak's."""
    cols = [c for c in df.columns if c.endswith("_dominant_peaks")]
    d = df.withColumn("_day", F.to_date(S.event_time(F.col("original_timestamp")))).unpivot(["vehicle_id", "_day"], cols, "sensor", "cell")
    d = d.select("vehicle_id", "_day", F.regexp_replace("sensor", "_dominant_peaks$", "").alias("sensor"), F.explode(S.peak_cell(F.col("cell"))).alias("p"))
    day = F.col("_day").cast("timestamp_ntz")
    ts = F.timestamp_add("MICROSECOND", F.timestamp_diff("MICROSECOND", F.date_trunc("day", "p.ts").cast("timestamp_ntz"), F.col("p.ts")), day)
    return d.select("vehicle_id", "sensor", ts.alias("ts"), F.col("p.amp").alias("amp"))


def sensor_events(peaks: DataFrame) -> DataFrame:
    """One event for each sensor and time: the first of equals, by vehicle."""
    return X.first_rows(peaks, ["sensor", "ts"], "vehicle_id", F.desc("amp"))


def wim_entries(df: DataFrame, time: str = "StartTimeStr", tolerance: float = 10.0, anchor: float = 0.0, gate_rows: str | None = None) -> DataFrame:
    """(vehicle, entry_ts, v_est, v_min, v_max, anchor) of weigh-in-motion rows; rows without a speed or time go.

    ``vehicle`` is the row's number in the file, rows that go counted; a table
    without such a column (``gate_rows``) is numbered in the order it is read.
    ``tolerance`` is in km/h, ``anchor`` the position of the gate in metres.
    """
    row = F.col(gate_rows) if gate_rows else None
    d = df if gate_rows else numbered(df, "_row")
    v = F.col("Velocity").cast("double") / 3.6
    ts = F.col(time) if dict(df.dtypes)[time].startswith("timestamp") else S.event_time(F.col(time))
    d = d.select((row if gate_rows else F.col("_row")).cast("long").alias("vehicle"), ts.alias("entry_ts"), v.alias("v_est"), (v - tolerance / 3.6).alias("v_min"), (v + tolerance / 3.6).alias("v_max"), F.lit(anchor).alias("anchor"))
    return d.where("v_est is not null and entry_ts is not null")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in the order they are read: an id within each partition and the counts of those before it."""
    d = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    part = d.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(X.by([], "_part").rowsBetween(X.W.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_before", before).drop("_n")  # a row for each partition
    return d.join(F.broadcast(part), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def read_positions(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """(row, channel, span, dist, sensor_id, side, axis, extra) of a bridge table.

    A byte order mark goes, ``columns`` renames, a number that isn't one is -1
    for ids and null for distances, and unknown columns become the map ``extra``.
    """
    names = {"vertical": "channel", "SPAN": "span", "DIST_M": "dist", "sensor_id": "sensor_id", "side": "side", "axis": "axis"} | (columns or {})
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))
    known = {new: F.col(f"`{old}`") for old, new in names.items() if old in df.columns}
    get = lambda c: F.trim(known[c]) if c in known else F.lit(None).cast("string")
    rest = [c for c in df.columns if c not in names]
    extra = F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`")))) if rest else F.create_map().cast("map<string,string>")
    d = numbered(df, "_row")
    return d.select(F.col("_row").alias("row"), get("channel").alias("channel"), get("span").alias("span"), S.number(get("dist")).alias("dist"), S.digits(get("sensor_id")).alias("sensor_id"), get("side").alias("side"), get("axis").alias("axis"), extra.alias("extra"))


def read_sensor_map(spark: SparkSession, path: str) -> DataFrame:
    """(sensor_id, vertical, flexural, torsional)."""
    return spark.read.option("header", True).csv(path).select(F.col("sensor_id").cast("int").alias("sensor_id"), "vertical", "flexural", "torsional")


def write_report(lines: DataFrame, path: str, append: bool = False) -> None:
    """A text sink for the single string column of a report."""
    lines.write.mode("append" if append else "overwrite").text(path)


def peak_sensors(columns: list[str], suffix: str = "_dominant_peaks", wanted: list[str] | None = None) -> list[str]:
    """The sensors of a peak table by its columns' endings, in order, those of ``wanted`` only if given."""
    own = [c.removesuffix(suffix) for c in columns if c.endswith(suffix)]
    return [c for c in own if wanted is None or c in wanted]


def write_peaks(points: DataFrame, sensors: list[str]) -> DataFrame:
    """The wide peak table of (vehicle_id, sensor, ts, amp)."""
    cell = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "amp"))), lambda p: F.concat_ws("|", F.date_format(p["ts"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), p["amp"])), ";")
    w = points.groupBy("vehicle_id").pivot("sensor", sensors).agg(cell)
    return w.select("vehicle_id", *(F.col(f"`{s}`").alias(f"{s}_dominant_peaks") for s in sensors))


class _Sheet(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def read(self, partition):
        rows = sheet_rows(self.path)
        head = next(rows, [])
        at = [head.index(c) if c in head else None for c in self.columns]
        for r in rows:
            yield tuple(r[i] if i is not None and i < len(r) else None for i in at)


class XlsxSource(DataSource):
    """format("xlsx"): the first sheet, its first row the header, all cells as text."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in next(sheet_rows(self.options["path"]), [])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Sheet(self.options["path"], schema.names)


def sheet_rows(path: str):
    """Rows of the first sheet of an .xlsx file as lists of text."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row"):
            out: list[str | None] = []
            for c in row.iter(f"{ns}c"):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A")).group():
                    at = at * 26 + ord(ch) - 64
                out += [None] * (at - 1 - len(out))
                v = c.find(f"{ns}v")
                text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                out.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            yield out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("path", path).load()
