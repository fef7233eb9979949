from datetime import datetime, timedelta

import pytest

from tremor.streaming import triggers

START = datetime(2025, 3, 1, 10, 0, 0)


def replay(spark, tmp_path, rows, operator):
    """What the operator gives once a stream of two files has been read."""
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        d = spark.createDataFrame([(s, START + timedelta(seconds=t), v) for s, t, v in part], "sensor string, ts timestamp, value double")
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("sensor string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert stream.isStreaming
    name = f"replay_{operator.__name__}"
    q = operator(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return spark.table(name)


def test_sessions_join_across_batches(spark, tmp_path):
    def sessions(stream):
        return triggers.trigger_sessions(stream, 1.0, "10 seconds")

    rows = [("a", 0, 1.5), ("a", 5, -3.0), ("a", 7, 0.2), ("b", 3, 0.9), ("a", 14, 1.0), ("a", 40, 2.0), ("b", 41, None), ("b", 44, 1.1)]
    got = sorted((r.sensor, (r.start - START).total_seconds(), (r.end - START).total_seconds(), r.hits, r.peak) for r in replay(spark, tmp_path, rows, sessions).collect())
    assert got == [("a", 0, 24, 3, 3.0), ("a", 40, 50, 1, 2.0), ("b", 44, 54, 1, 1.1)]


def test_minute_means(spark, tmp_path):
    rows = [("a", 0, 1.0), ("a", 59, 3.0), ("a", 60, 5.0), ("b", 1, None)]
    got = {(r.sensor, (r.start - START).total_seconds()): (r["mean"], r.variance) for r in replay(spark, tmp_path, rows, triggers.minute_means).collect()}
    assert got.pop(("b", 0)) == (None, None)
    assert got == {("a", 0): pytest.approx((2.0, 1.0)), ("a", 60): pytest.approx((5.0, 0.0))}
