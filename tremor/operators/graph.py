"""Connected components of a link table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tremor-checkpoint-"))
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id that the links reach; labels spread to neighbours and then jump, for about log n rounds."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    e = saved(e.union(e.select("v", "u")).where("u <> v").distinct())
    label = saved(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).withColumnRenamed("u", "id"))
    for _ in range(max_rounds):
        near = e.join(label.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("c").alias("n")).withColumnRenamed("u", "id")
        step = label.join(near, "id").select("id", "c", F.least("c", "n").alias("t"))
        new = saved(step.join(label.select(F.col("id").alias("t"), F.col("c").alias("j")), "t").select("id", "c", F.least("t", "j").alias("n")))
        label = new.select("id", F.col("n").alias("c"))
        if not new.where("n <> c").limit(1).count():
            return label.withColumnRenamed("c", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
