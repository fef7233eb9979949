"""The bridge: spans, sensors, thresholds, boundaries between spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators import windows as X

TRIGGER = 0.002
NEAR = 1e-6


def load(sensors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Sensors (last row of an id wins, by ``row``) with their thresholds; the trigger has a default."""
    own = X.first_rows(sensors, ["sensor_id"], F.desc("row"))
    t = thresholds.dropDuplicates(["sensor_id"])
    return own.join(t, "sensor_id", "left").withColumn("trigger_threshold", F.coalesce("trigger_threshold", F.lit(TRIGGER)))


def levels(thresholds: DataFrame, sigmas=(1, 2, 3)) -> DataFrame:
    """(sensor_id, sigma, threshold) from one column for each sigma."""
    names = [f"threshold_{s}sigma" for s in sigmas]
    return thresholds.unpivot(["sensor_id"], names, "_n", "threshold").select("sensor_id", F.regexp_extract("_n", r"(\d+)", 1).cast("int").alias("sigma"), "threshold").where("threshold is not null")


def unmatched(thresholds: DataFrame, sensors: DataFrame) -> DataFrame:
    return thresholds.join(sensors, "sensor_id", "left_anti")


def paired(sensors: DataFrame) -> DataFrame:
    """Pairs at one place (to a millionth) of a span."""
    key = F.round(F.col("dist") / NEAR).cast("long")
    a = sensors.select("span", key.alias("_k"), F.col("sensor_id").alias("a"), F.col("dist").alias("_da"))
    # places on either side of a rounding edge are looked up as well
    b = sensors.select("span", F.explode(F.array(key - 1, key, key + 1)).alias("_k"), F.col("sensor_id").alias("b"), F.col("dist").alias("_db"))
    return a.join(b, ["span", "_k"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_da") - F.col("_db")) < NEAR)).select("span", "a", "b", F.col("_da").alias("dist"))


def boundaries(sensors: DataFrame) -> DataFrame:
    """(span_a, span_b, gap, tails, entries): neighbouring spans with the sensors at their facing ends."""
    e = sensors.groupBy("span").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    # spans are few: one row for each
    w = X.by([], "lo", "span")
    e = e.withColumns({"span_b": F.lead("span").over(w), "lo_b": F.lead("lo").over(w)}).where("span_b is not null")
    near = lambda at: F.abs(F.col("dist") - F.col(at)) < NEAR
    gather = F.sort_array(F.collect_list("sensor_id"))
    tails = e.join(sensors, "span").where(near("hi")).groupBy("span", "span_b").agg(gather.alias("tails"))
    heads = e.join(sensors.withColumnRenamed("span", "span_b"), "span_b").where(near("lo_b")).groupBy("span", "span_b").agg(gather.alias("entries"))
    return e.join(tails, ["span", "span_b"]).join(heads, ["span", "span_b"]).select(F.col("span").alias("span_a"), "span_b", (F.col("lo_b") - F.col("hi")).alias("gap"), "tails", "entries")


def resolve(request: DataFrame, sensors: DataFrame) -> DataFrame:
    """(ord, ref, sensor_id) for references by id or by number, in the order asked; a null id is a miss."""
    ids = sensors.select(F.col("sensor_id").cast("string").alias("ref"), "sensor_id").unionByName(sensors.select(F.concat(F.lit("#"), F.col("number")).alias("ref"), "sensor_id"))
    return request.join(ids.groupBy("ref").agg(F.min("sensor_id").alias("sensor_id")), "ref", "left")


def to_json(sensors: DataFrame) -> DataFrame:
    """(span, doc): a nested document for each span."""
    return sensors.groupBy("span").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("dist", "sensor_id"))).alias("sensors"))).alias("doc"))
