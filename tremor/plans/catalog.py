"""All queries by name, on the driver's tables, with the SQL for those that SQL can express.

Channels are the event types of `events`, and a day of a channel stands for a file:
signals (`sensor`) are files, so no window, sort or Python call holds more than one.
Weigh-in-motion records are `orders`; the bridge is `supplier`; waveforms are
`embeddings`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.operators import bridge, cluster, correlate, events, reports, samples, spectral, stats, tracking, traffic
from tremor.operators import windows as X
from tremor.operators.graph import saved

KEY = ["sensor"]
COUNT = 0.980665  # a channel's unit in cm/s^2
HIT = 150.0
SPAN = 5

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql if sql.lstrip().startswith("WITH") else f"WITH {CTE}\n{sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


CTE = """s0 AS (SELECT event_type || '/' || strftime(ts, '%Y-%m-%d') AS sensor, event_type AS channel, event_id, user_id, ts, value * CAST(0.980665 AS DOUBLE) AS value FROM events),
s AS (SELECT sensor, channel, CAST(row_number() OVER (PARTITION BY sensor ORDER BY ts, event_id) - 1 AS BIGINT) AS i, ts, user_id, value FROM s0),
c AS (SELECT sensor, i, ts, user_id, value - avg(value) OVER (PARTITION BY sensor) AS value FROM s),
m AS (SELECT *, max(CASE WHEN abs(value) >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS active FROM c),
r0 AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER (PARTITION BY sensor ORDER BY i), false) THEN 1 ELSE 0 END AS st FROM m),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY sensor ORDER BY i) AS BIGINT) AS run FROM r0)"""
RUN = ", g AS (SELECT * FROM r WHERE active)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def raw(spark, sf, since=None, until=None) -> DataFrame:
    """Samples of the files from the day of ``since`` to that of ``until``: the days are pushed down to the scan."""
    e = table(spark, sf, "events")
    if since is not None:
        e = e.where((F.col("ts") >= F.lit(since).cast("date").cast("timestamp_ntz")) & (F.col("ts") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz")))
    e = e.select(F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("sensor"), F.col("event_type").alias("channel"), "event_id", "user_id", "ts", (F.col("value") * COUNT).alias("value"))
    return samples.index(e, KEY, "ts", "event_id").withColumn("i", F.col("i").cast("long"))


def _by_channel(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("sensor"), "ts", (F.col("value") * COUNT).alias("value"))


def signal(spark, sf) -> DataFrame:
    return samples.remove_dc(raw(spark, sf), KEY)


def active(spark, sf) -> DataFrame:
    return events.activity_mask(signal(spark, sf), KEY, F.lit(HIT), SPAN)


def _rounded(c, digits: int):
    """Rounding by decimals is dear where a double is tiny: what rounds to zero is zero at once."""
    return F.when(F.abs(c) < 0.1**digits / 4, 0.0).otherwise(F.round(c, digits) + 0.0)


def out(df: DataFrame, digits: int = 4) -> DataFrame:
    """Whole numbers as long, and doubles rounded, as the SQL has them."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((c.cast("long") if kind in ("int", "smallint") else _rounded(c, digits) if kind == "double" else c).alias(name))
    return df.select(*cols)


# --- samples and windows ------------------------------------------------------


@query("SELECT sensor, i, round(value, 4) + 0.0 AS value FROM c")
def dc_removal(spark, sf):
    return out(signal(spark, sf).select("sensor", "i", "value"))


@query("SELECT sensor, i, ts FROM s WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 HOUR AND ts <= (SELECT min(ts) FROM events) + INTERVAL 6 HOUR")
def time_window_closed(spark, sf):
    start = table(spark, sf, "events").agg(F.min("ts")).first()[0] + timedelta(hours=1)
    return samples.between(raw(spark, sf, start, start + timedelta(minutes=300)), start, 300).select("sensor", "i", "ts")


@query("SELECT sensor, i, ts FROM s WHERE ts >= (SELECT min(ts) FROM events) AND ts < (SELECT min(ts) FROM events) + INTERVAL 15 MINUTE")
def time_window_halfopen(spark, sf):
    start = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    return samples.between(raw(spark, sf, start, start + timedelta(minutes=15)), start, 15, closed=False).select("sensor", "i", "ts")


@query("SELECT sensor, i, round(value, 4) + 0.0 AS value FROM c WHERE i % 5 = 0")
def decimate(spark, sf):
    return out(samples.decimate(signal(spark, sf), 5).select("sensor", "i", "value"))


@query("SELECT sensor, CAST(count(*) FILTER (abs(value) <= 100) AS BIGINT) AS noise, CAST(count(*) FILTER (abs(value) > 100) AS BIGINT) AS signal FROM c GROUP BY sensor")
def noise_filter(spark, sf):
    v = F.col("value")
    return signal(spark, sf).groupBy("sensor").agg(F.count_if(samples.noise(v, F.lit(100.0))).alias("noise"), F.count_if(samples.signal(v, F.lit(100.0))).alias("signal"))


@query("SELECT sensor, i, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 4) + 0.0 AS value FROM c WINDOW w AS (PARTITION BY sensor)")
def normalise(spark, sf):
    return out(samples.normalise(signal(spark, sf), KEY).select("sensor", "i", "value"))


@query("SELECT sensor, i, round(avg(value) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) + 0.0 AS ma FROM c")
def rolling_centered(spark, sf):
    return out(X.rolling_mean(signal(spark, sf), KEY, "i", "value", 4, centre=True).select("sensor", "i", "ma"))


@query("SELECT sensor, i, round(avg(value) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) + 0.0 AS ma FROM c")
def rolling_trailing(spark, sf):
    return out(X.rolling_mean(signal(spark, sf), KEY, "i", "value", 4).select("sensor", "i", "ma"))


@query("SELECT sensor, i, round(sqrt(avg(value * value) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)), 4) + 0.0 AS rms FROM c QUALIFY count(*) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) = 30")
def rms_envelope(spark, sf):
    return out(X.rms_envelope(signal(spark, sf), KEY, "value", 30).select("sensor", "i", "rms"))


@query("SELECT sensor, round(CAST(coalesce(sum(x), 0) AS DOUBLE) / count(*), 6) AS zcr FROM (SELECT sensor, CASE WHEN sign(value) <> lag(sign(value)) OVER (PARTITION BY sensor ORDER BY i) THEN 1 ELSE 0 END AS x FROM c) GROUP BY sensor")
def zero_crossings(spark, sf):
    return out(X.zero_crossings(signal(spark, sf), KEY, "value"), 6)


@query("SELECT sensor, i, round(date_diff('second', lag(ts) OVER (PARTITION BY sensor ORDER BY i), ts) / 60, 4) AS gap FROM (SELECT sensor, i, date_trunc('second', ts) AS ts FROM s)")
def gap_minutes(spark, sf):
    return out(X.gaps(raw(spark, sf).withColumn("ts", F.date_trunc("second", "ts")), KEY, "i", "ts").select("sensor", "i", "gap"))


@query("SELECT sensor, i FROM (SELECT sensor, i, ts, lag(ts) OVER w AS a, lead(ts) OVER w AS b FROM (SELECT sensor, i, date_trunc('second', ts) AS ts FROM s) WINDOW w AS (PARTITION BY sensor ORDER BY ts)) WHERE coalesce(ts - a > INTERVAL 10 MINUTE, true) AND coalesce(b - ts > INTERVAL 10 MINUTE, true)")
def isolated_timestamps(spark, sf):
    return X.isolated(raw(spark, sf).withColumn("ts", F.date_trunc("second", "ts")), KEY, "ts", 10).select("sensor", "i")


@query("SELECT sensor, user_id, event_id FROM (SELECT event_type AS sensor, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def dedup_heaviest(spark, sf):
    return X.first_rows(raw(spark, sf).drop("sensor").withColumnRenamed("channel", "sensor"), ["sensor", "user_id"], F.desc("value"), "event_id").select("sensor", "user_id", "event_id")


@query("SELECT user_id, sensor, i, round(date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1e6, 6) AS rel FROM s")
def relative_seconds(spark, sf):
    rel = F.timestamp_diff("MICROSECOND", F.min("ts").over(X.W.partitionBy("user_id")), F.col("ts")) / 1e6
    return out(raw(spark, sf).select("user_id", "sensor", "i", rel.alias("rel")), 6)


@query("SELECT sensor, cluster, CAST(count(*) AS BIGINT) AS n, round(min(value), 4) AS lo FROM (SELECT sensor, value, CAST(sum(CASE WHEN value - p <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY sensor ORDER BY value, i) AS BIGINT) AS cluster FROM (SELECT *, lag(value) OVER (PARTITION BY sensor ORDER BY value, i) AS p FROM s)) GROUP BY sensor, cluster")
def velocity_clusters(spark, sf):
    d = X.gap_islands(raw(spark, sf), KEY, "value", 0.5, "cluster")
    return out(d.groupBy("sensor", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo")))


# --- events -------------------------------------------------------------------


@query("SELECT sensor, i, active FROM m")
def activity_mask(spark, sf):
    return active(spark, sf).select("sensor", "i", "active")


@query("SELECT sensor, i, round(CASE WHEN active THEN value ELSE 0.0 END, 4) + 0.0 AS filtered FROM m")
def threshold_filter(spark, sf):
    return out(events.threshold_filter(signal(spark, sf), KEY, F.lit(HIT), SPAN).select("sensor", "i", "filtered"))


@query("""SELECT sensor, threshold, round(sqrt(avg(CASE WHEN a THEN 0.0 ELSE value * value END)), 4) + 0.0 AS rmse, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS retained
FROM (SELECT *, max(CASE WHEN abs(value) >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY sensor, threshold ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS a FROM c, (SELECT unnest([50.0, 100.0, 150.0, 200.0])::DOUBLE AS threshold)) GROUP BY sensor, threshold""")
def threshold_sweep(spark, sf):
    d = events.threshold_sweep(signal(spark, sf), KEY, [50.0, 100.0, 150.0, 200.0], SPAN)
    return d.select("sensor", "threshold", (F.round("rmse", 4) + 0.0).alias("rmse"), F.round("retained", 6).alias("retained"))


@query(f"WITH {CTE}{RUN} SELECT sensor, run, min(i) AS start_idx, max(i) + 1 AS end_idx FROM g GROUP BY sensor, run")
def event_runs(spark, sf):
    return out(events.runs(active(spark, sf), KEY))


@query(f"""WITH {CTE}{RUN}, z AS (SELECT *, value - avg(value) OVER (PARTITION BY sensor, run) AS d, count(*) OVER (PARTITION BY sensor, run) AS k FROM g)
SELECT sensor, run, min(i) AS start_idx, max(i) + 1 AS end_idx, count(*) AS n, round(avg(value), 4) + 0.0 AS mean, round(stddev_pop(value), 4) + 0.0 AS std, round(min(value), 4) + 0.0 AS vmin, round(max(value), 4) + 0.0 AS vmax, round(sqrt(avg(value * value)), 4) + 0.0 AS rms, round(max(abs(value)), 4) + 0.0 AS peak, round(sum(value * value), 2) + 0.0 AS energy,
CASE WHEN count(*) > 1 THEN round(avg(d * d * d) / pow(avg(d * d), 1.5), 3) + 0.0 END AS skew, CASE WHEN count(*) > 1 THEN round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 3) + 0.0 END AS kurt FROM z GROUP BY sensor, run""")
def event_summary(spark, sf):
    d = events.event_summary(active(spark, sf), KEY)
    # one sample has neither; two or more of one value can't arise from this signal
    shape = {c: F.when(F.col("n") > 1, F.round(c, 3)) for c in ("skew", "kurt")}
    return out(d.withColumns({"energy": F.round("energy", 2), **shape}))


@query(f"""WITH {CTE}{RUN}, n AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM g WINDOW w AS (PARTITION BY sensor, run ORDER BY i)),
e AS (SELECT *, coalesce((a IS NULL AND ((value > 0 AND value > b) OR (value < 0 AND value < b))) OR (value >= a AND value >= b) OR (value <= a AND value <= b), false) AS x FROM n),
f AS (SELECT sensor, run, first(i ORDER BY i) AS first_idx, first(value ORDER BY i) AS first_value, first(i ORDER BY abs(value) DESC, i) AS peak_idx, first(value ORDER BY abs(value) DESC, i) AS peak_value FROM e WHERE x GROUP BY sensor, run),
h AS (SELECT sensor, run, first(i ORDER BY abs(value) DESC, i) AS i, first(value ORDER BY abs(value) DESC, i) AS v FROM e GROUP BY sensor, run)
SELECT sensor, run, coalesce(first_idx, i) AS first_idx, round(coalesce(first_value, v), 4) + 0.0 AS first_value, coalesce(peak_idx, i) AS peak_idx, round(coalesce(peak_value, v), 4) + 0.0 AS peak_value FROM h LEFT JOIN f USING (sensor, run)""")
def first_dominant_peaks(spark, sf):
    return out(events.peaks(active(spark, sf), KEY))


TRIGGER = """, h AS (SELECT sensor, i, CASE WHEN i - lag(i) OVER (PARTITION BY sensor ORDER BY i) < 10 THEN 0 ELSE 1 END AS st FROM c WHERE abs(value) >= 200),
n AS (SELECT sensor, count(*) AS n FROM c GROUP BY sensor),
t AS (SELECT sensor, i, n, CAST(sum(st) OVER (PARTITION BY sensor ORDER BY i) AS BIGINT) AS event FROM h JOIN n USING (sensor)),
u AS (SELECT *, lag(i) OVER (PARTITION BY sensor, event ORDER BY i) IS NULL OR least(i + 10, n) > least(lag(i) OVER (PARTITION BY sensor, event ORDER BY i) + 10, n) AS mv FROM t),
ev AS (SELECT sensor, event, greatest(min(i) - 3, 0) AS start_idx, max(least(i + 10, n)) AS end_idx, count(*) FILTER (mv) AS n_triggers FROM u GROUP BY sensor, event)"""


@query(f"WITH {CTE}{TRIGGER} SELECT * FROM ev")
def trigger_events(spark, sf):
    return out(events.triggers(signal(spark, sf), KEY, 200.0, 10, 3))


@query(f"WITH {CTE}{TRIGGER} SELECT sensor, event, start_idx, end_idx, n_triggers, first(i ORDER BY abs(value) DESC, i) AS peak_idx, round(first(value ORDER BY abs(value) DESC, i), 4) + 0.0 AS peak_value, round(sum(abs(value)) * 0.01, 4) + 0.0 AS energy FROM ev JOIN c USING (sensor) WHERE i >= start_idx AND i < end_idx AND end_idx - start_idx BETWEEN 5 AND 100 GROUP BY ALL")
def trigger_event_features(spark, sf):
    d = signal(spark, sf)
    return out(events.event_features(events.triggers(d, KEY, 200.0, 10, 3), d, KEY, 0.01, 5, 100))


ENVELOPE = """, n AS (SELECT sensor, count(*) AS n FROM c GROUP BY sensor),
p AS (SELECT sensor, i, abs(value) AS v, true AS own FROM c UNION ALL SELECT sensor, -i - 1, abs(value), false FROM c WHERE i < {h} UNION ALL SELECT sensor, 2 * n - i - 1, abs(value), false FROM c JOIN n USING (sensor) WHERE i >= n - {h}),
e AS (SELECT sensor, i, env FROM (SELECT *, avg(v) OVER (PARTITION BY sensor ORDER BY i ROWS BETWEEN {h} PRECEDING AND {h1} FOLLOWING) AS env FROM p) WHERE own),
l AS (SELECT sensor, {level} AS level FROM e GROUP BY sensor),
a AS (SELECT sensor, i, env > level AS act FROM e JOIN l USING (sensor)),
q AS (SELECT *, CASE WHEN act AND NOT coalesce(lag(act) OVER (PARTITION BY sensor ORDER BY i), false) THEN 1 ELSE 0 END AS st FROM a),
k AS (SELECT sensor, run, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, sum(st) OVER (PARTITION BY sensor ORDER BY i) AS run FROM q) WHERE act GROUP BY sensor, run),
o AS (SELECT *, CAST(sum(CASE WHEN s - pe {join} {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY sensor ORDER BY s) AS BIGINT) AS event FROM (SELECT *, lag(e) OVER (PARTITION BY sensor ORDER BY s) AS pe FROM k))
SELECT sensor, event, min(s) AS start_idx, max(e) AS end_idx FROM o GROUP BY sensor, event HAVING max(e) - min(s) >= {least}"""


@query("WITH " + CTE + ENVELOPE.format(h=5, h1=4, level="quantile_cont(env, 0.85)", join="<=", gap=6, least=4))
def envelope_events(spark, sf):
    return out(events.envelope_events(signal(spark, sf), KEY, 10, 6, 4))


@query("WITH " + CTE + ENVELOPE.format(h=5, h1=4, level="avg(env) + 2 * stddev_pop(env)", join="<", gap=6, least=2))
def adaptive_events(spark, sf):
    return out(events.envelope_events(signal(spark, sf), KEY, 10, 6, 2, percentile=None, sigmas=2.0, strict=True))


# --- aggregates ---------------------------------------------------------------


@query("SELECT sensor, mean, std, round(mean + round(3 * std, 6), 4) AS threshold_x FROM (SELECT channel AS sensor, round(avg(abs(value)), 6) AS mean, round(stddev_samp(abs(value)), 6) AS std FROM s GROUP BY channel)")
def sensor_thresholds(spark, sf):
    return stats.sensor_thresholds(_by_channel(spark, sf)).withColumn("threshold_x", F.round("threshold_x", 4))


@query("SELECT sensor, i // 100 AS chunk, first(ts ORDER BY i) AS start_time, last(ts ORDER BY i) AS end_time, round(avg(value), 4) + 0.0 AS mean, round(var_pop(value), 4) + 0.0 AS variance, round(CASE WHEN var_pop(value) > 0 THEN ln(var_pop(value)) END, 4) + 0.0 AS log_variance FROM s GROUP BY sensor, chunk")
def chunk_reduction(spark, sf):
    return out(stats.chunk_reduction(raw(spark, sf), KEY))


MINUTES = "mi AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute, count(*) FILTER (event_id % 17 = 0) AS missing, count(*) AS total FROM events WHERE event_id % 23 <> 0 GROUP BY ALL)"


def _minutes(spark, sf):
    e = table(spark, sf, "events")
    d = e.select(F.to_date("ts").alias("day"), F.when(F.col("event_id") % 23 != 0, F.col("ts")).alias("ts"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return stats.missing_by_minute(d, "day", "ts", "value")


@query(f"WITH {MINUTES} SELECT day, minute, missing, total, round(missing / total, 6) AS missing_frac, CASE WHEN missing / total > 0.9 THEN 'Failed' WHEN missing / total > 0.1 THEN 'Degraded' ELSE 'Working' END AS status FROM mi")
def missing_by_minute(spark, sf):
    return out(_minutes(spark, sf), 6)


@query(f"WITH {MINUTES} SELECT day, minute, round(missing / total, 6) AS missing_frac FROM mi WHERE missing / total > 0.1")
def outages(spark, sf):
    return out(_minutes(spark, sf).where("missing_frac > 0.1").select("day", "minute", "missing_frac"), 6)


DAYS = "d AS (SELECT day, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(total) AS BIGINT) AS total, 100 * sum(missing) / sum(total) AS p FROM mi GROUP BY day)"


@query(f"WITH {MINUTES}, {DAYS} SELECT day, missing, total, round(p, 4) AS missing_pct, CASE WHEN p > 10 THEN 'red' WHEN p > 5 THEN 'orange' ELSE 'green' END AS severity FROM d")
def status_bands(spark, sf):
    return out(stats.missing_by_day(_minutes(spark, sf)))


@query(f"WITH {MINUTES}, {DAYS} SELECT count(*) AS days, round(avg(p), 4) AS mean_pct, round(quantile_cont(p, 0.5), 4) AS median_pct, round(max(p), 4) AS max_pct, round(min(p), 4) AS min_pct, count(*) FILTER (p > 5) AS over_5, count(*) FILTER (p > 10) AS over_10, (SELECT count(*) FROM mi WHERE missing / total > 0.1) AS outages FROM d")
def missing_summary(spark, sf):
    m = _minutes(spark, sf)
    return out(stats.missing_summary(stats.missing_by_day(m), m))


@query("SELECT sensor, bin, CAST(count(i) AS BIGINT) AS n FROM (SELECT sensor, unnest(range(10)) AS bin FROM (SELECT DISTINCT sensor FROM s)) LEFT JOIN (SELECT sensor, i, least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin FROM s JOIN (SELECT sensor, min(value) AS lo, max(value) AS hi FROM s GROUP BY sensor) USING (sensor)) USING (sensor, bin) GROUP BY sensor, bin")
def histogram(spark, sf):
    return stats.histogram(raw(spark, sf), KEY, "value", 10)


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def dup_counts(spark, sf):
    return stats.duplicates(table(spark, sf, "orders"), ["o_custkey"])


@query("WITH g AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS t FROM lineitem), f AS (SELECT l_suppkey, count(*) AS n, regr_intercept(t, x) AS a, regr_slope(t, x) AS b FROM g GROUP BY l_suppkey) SELECT l_suppkey, n, round(CASE WHEN n >= 2 AND b > 0 THEN a END, 2) + 0.0 AS a, round(CASE WHEN n >= 2 AND b > 0 THEN 1 / b END, 6) AS u FROM f")
def line_fit(spark, sf):
    d = stats.line_fit(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return d.select("l_suppkey", "n", (F.round("a", 2) + 0.0).alias("a"), F.round("u", 6).alias("u"))


# --- traffic ------------------------------------------------------------------

T = """q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS datetime, event_type, user_id FROM events),
tc AS (SELECT datetime, CAST(date_trunc('day', datetime) AS DATE) AS date, CAST(hour(datetime) AS BIGINT) AS hour, CASE WHEN isodow(datetime) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, count(*) AS total, count(*) FILTER (user_id % 5 = 0) AS Car, count(*) FILTER (user_id % 5 = 1) AS Bus, count(*) FILTER (user_id % 5 = 2) AS Motorbike, count(*) FILTER (user_id % 5 = 3) AS Truck, count(*) FILTER (user_id % 5 = 4) AS Van FROM q GROUP BY ALL)"""
CLASSES = ["Car", "Bus", "Motorbike", "Truck", "Van"]


def quarters(spark, sf) -> DataFrame:
    ts = F.col("ts")
    q = table(spark, sf, "events").select(F.timestamp_add("MINUTE", -(F.minute(ts) % 15), F.date_trunc("minute", ts)).cast("timestamp_ntz").alias("datetime"), "user_id")
    g = q.groupBy("datetime").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("user_id") % 5 == k).alias(c) for k, c in enumerate(CLASSES)))
    label = F.element_at(F.array(*map(F.lit, S.DAYS)), F.weekday("datetime") + 1)
    return traffic.temporal(g.withColumn("day", label))


@query(f"WITH {T} SELECT date, CAST(sum(total) AS BIGINT) AS total FROM tc GROUP BY date")
def daily_traffic(spark, sf):
    return traffic.daily(quarters(spark, sf), "total")


@query(f"WITH {T}, d AS (SELECT date, CAST(sum(total) AS BIGINT) AS total FROM tc GROUP BY date) SELECT round(avg(total), 4) AS mean, min(total) AS min_total, first(date ORDER BY total, date) AS min_date, max(total) AS max_total, first(date ORDER BY total DESC, date) AS max_date FROM d")
def daily_extremes(spark, sf):
    return out(traffic.extremes(traffic.daily(quarters(spark, sf), "total")))


@query(f"WITH {T}, u AS (SELECT name, CAST(sum(total) AS BIGINT) AS total FROM (UNPIVOT (SELECT Car, Bus, Motorbike, Truck, Van FROM tc) ON Car, Bus, Motorbike, Truck, Van INTO NAME name VALUE total) GROUP BY name) SELECT name, total, round(total * 100.0 / sum(total) OVER (), 4) AS pct FROM u")
def class_share(spark, sf):
    return out(traffic.shares(quarters(spark, sf), CLASSES))


@query(f"WITH {T} SELECT hour, round(avg(Truck + Bus) FILTER (day_type = 'Weekday'), 4) AS Weekday, round(avg(Truck + Bus) FILTER (day_type = 'Weekend'), 4) AS Weekend FROM tc GROUP BY hour")
def heavy_pivot(spark, sf):
    d = traffic.load_columns(quarters(spark, sf)).groupBy("hour").pivot("day_type", ["Weekday", "Weekend"]).agg(F.avg("heavy"))
    return out(d)


@query(f"WITH {T}, h AS (SELECT day_type, hour, avg(total) AS mean FROM tc GROUP BY day_type, hour) SELECT day_type, hour, round(mean, 4) AS mean, row_number() OVER (PARTITION BY day_type ORDER BY mean DESC, hour) AS rank FROM h QUALIFY rank <= 5")
def peak_hours(spark, sf):
    return out(traffic.peak_hours(quarters(spark, sf), "total"))


@query(f"WITH {T} SELECT datetime, round(1.0 * Car + 0.5 * Motorbike + 1.5 * Van + 3.0 * Bus + 5.0 * Truck, 4) AS load_index, Truck + Bus AS heavy, round(100.0 * (Truck + Bus) / total, 4) AS heavy_pct, (Truck + Bus) * total AS stress_score FROM tc")
def load_index(spark, sf):
    return out(traffic.load_columns(quarters(spark, sf)).select("datetime", "load_index", "heavy", "heavy_pct", "stress_score"))


@query(f"WITH {T} SELECT hour, round(avg(Truck), 4) AS truck, round(avg(Bus), 4) AS bus, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / 4, 4) AS weekly FROM tc GROUP BY hour")
def hour_profiles(spark, sf):
    return out(quarters(spark, sf).groupBy("hour").agg(F.avg("Truck").alias("truck"), F.avg("Bus").alias("bus"), F.sum("total").alias("total"), (F.sum("total") / 4).alias("weekly")))


@query("WITH q AS (SELECT CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'Morning Rush' WHEN hour(ts) BETWEEN 10 AND 15 THEN 'Midday' WHEN hour(ts) BETWEEN 16 AND 19 THEN 'Evening Rush' ELSE 'Night' END AS time_category, user_id % 4 AS lane FROM events) SELECT time_category, lane, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY time_category), 4) AS pct FROM q GROUP BY time_category, lane")
def lane_share(spark, sf):
    q = table(spark, sf, "events").select(S.time_category(F.hour("ts")).alias("time_category"), (F.col("user_id") % 4).alias("lane"))
    g = q.groupBy("time_category", "lane").agg(F.count(F.lit(1)).alias("n"))
    return out(g.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(X.W.partitionBy("time_category"))))


@query(f"""WITH {T}, cl AS (SELECT datetime, total AS total_classi FROM tc WHERE minute(datetime) <> 0), co AS (SELECT datetime, Car + Truck AS total_lanes FROM tc WHERE minute(datetime) <> 15), tr AS (SELECT datetime, Van + Bus AS transits FROM tc WHERE minute(datetime) <> 30)
SELECT datetime, total_classi, total_lanes, transits, total_classi - total_lanes AS classi_corsie, total_classi - transits AS classi_transiti FROM cl FULL JOIN co USING (datetime) FULL JOIN tr USING (datetime)""")
def cross_validation(spark, sf):
    q, minute = quarters(spark, sf), F.minute("datetime")
    d = traffic.merge(q.where(minute != 0).select("datetime", F.col("total").alias("total_classi")), q.where(minute != 15).select("datetime", (F.col("Car") + F.col("Truck")).alias("total_lanes")), q.where(minute != 30).select("datetime", (F.col("Van") + F.col("Bus")).alias("transits")))
    return d.select("datetime", "total_classi", "total_lanes", "transits", "classi_corsie", "classi_transiti")


@query("SELECT o_orderpriority AS class, count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(avg(o_totalprice), 2) AS mean, round(avg(o_totalprice * 25), 1) AS momentum FROM orders WHERE o_totalprice > 30000 GROUP BY o_orderpriority")
def wim_by_class(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 30000").select(F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("weight"), F.lit(25.0).alias("velocity"))
    w = traffic.wim(o)
    return w.groupBy("class").agg(F.count("weight").alias("n"), F.round(F.min("weight"), 2).alias("lo"), F.round(F.max("weight"), 2).alias("hi"), F.round(F.avg("weight"), 2).alias("mean"), F.round(F.avg("momentum"), 1).alias("momentum"))


# --- bridge -------------------------------------------------------------------

B = "b AS (SELECT s_suppkey AS sensor_id, s_nationkey AS span, s_nationkey * 1000 + (s_suppkey // 2) * 2.5 AS dist FROM supplier), t AS (SELECT s_suppkey AS sensor_id, round(abs(s_acctbal) / 1e6, 6) AS th FROM supplier WHERE s_suppkey % 3 <> 0)"


def _sensors(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sensor_id"), F.col("s_nationkey").cast("long").alias("span"), (F.col("s_nationkey") * 1000 + F.floor(F.col("s_suppkey") / 2) * 2.5).alias("dist"), F.col("s_suppkey").cast("string").alias("number"), F.lit(0).alias("row"))


def _thresholds(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("sensor_id"), F.round(F.abs("s_acctbal") / 1e6, 6).alias("trigger_threshold"))


@query(f"WITH {B}, e AS (SELECT span, min(dist) AS lo, max(dist) AS hi FROM b GROUP BY span), n AS (SELECT span, hi, lead(span) OVER (ORDER BY lo, span) AS span_b, lead(lo) OVER (ORDER BY lo, span) AS lo_b FROM e) SELECT CAST(span AS BIGINT) AS span_a, CAST(span_b AS BIGINT) AS span_b, round(lo_b - hi, 4) AS gap, (SELECT string_agg(sensor_id, ',' ORDER BY sensor_id) FROM b WHERE b.span = n.span AND b.dist = hi) AS tails, (SELECT string_agg(sensor_id, ',' ORDER BY sensor_id) FROM b WHERE b.span = n.span_b AND b.dist = lo_b) AS entries FROM n WHERE span_b IS NOT NULL")
def bridge_boundaries(spark, sf):
    d = bridge.boundaries(_sensors(spark, sf))
    return out(d.withColumns({c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in ("tails", "entries")}))


@query(f"WITH {B} SELECT sensor_id, coalesce(th, 0.002) AS trigger_threshold FROM b LEFT JOIN t USING (sensor_id)")
def bridge_thresholds(spark, sf):
    return bridge.load(_sensors(spark, sf), _thresholds(spark, sf)).select("sensor_id", "trigger_threshold")


@query(f"WITH {B} SELECT sensor_id FROM b WHERE sensor_id NOT IN (SELECT sensor_id FROM t)")
def missing_thresholds(spark, sf):
    return bridge.unmatched(_sensors(spark, sf), _thresholds(spark, sf)).select("sensor_id")


@query(f"WITH {B} SELECT CAST(x.span AS BIGINT) AS span, x.sensor_id AS a, y.sensor_id AS b, round(x.dist, 4) AS dist FROM b x JOIN b y ON x.span = y.span AND x.sensor_id < y.sensor_id AND abs(x.dist - y.dist) < 1e-6")
def paired_sensors(spark, sf):
    return out(bridge.paired(_sensors(spark, sf)))


@query("WITH r AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '#' || c_custkey END AS ref FROM customer) SELECT ord, ref, s_suppkey AS sensor_id FROM r LEFT JOIN supplier ON replace(ref, '#', '') = CAST(s_suppkey AS VARCHAR)")
def resolve_sensors(spark, sf):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(k.alias("ord"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("#"), k)).alias("ref"))
    return bridge.resolve(r, _sensors(spark, sf)).select("ord", "ref", "sensor_id")


# --- correlation and spectra --------------------------------------------------

E = "em AS (SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def waves(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"))


@query(f"WITH {E}, t AS (SELECT vec_id, i - 8 AS k, value + 0.01 * i AS t FROM em WHERE i BETWEEN 8 AND 23), l AS (SELECT vec_id, lag, t.t, em.value FROM t JOIN (SELECT unnest(range(60)) AS lag) ON true JOIN em USING (vec_id) WHERE em.i = 4 + lag + k AND 4 + lag < 64 - 16) SELECT vec_id, lag, round(sum(t * value) / (sqrt(sum(t * t)) * sqrt(sum(value * value))), 4) + 0.0 AS score FROM l GROUP BY vec_id, lag HAVING count(*) = 16")
def template_slide(spark, sf):
    w = waves(spark, sf)
    t = w.where("i between 8 and 23").select("vec_id", (F.col("i") - 8).alias("k"), (F.col("value") + 0.01 * F.col("i")).alias("t"), F.lit(4).cast("long").alias("start"))
    return out(correlate.template_slide(t, w, ["vec_id"], 60))


@query(f"WITH {E}, a AS (SELECT vec_id, i, value FROM em WHERE i < 32), b AS (SELECT vec_id, i - 32 AS i, value FROM em WHERE i >= 32), ms AS (SELECT vec_id, avg(value) FILTER (i < 32) AS m1, avg(value) FILTER (i >= 32) AS m2, 32 * var_pop(value) FILTER (i < 32) AS e1, 32 * var_pop(value) FILTER (i >= 32) AS e2 FROM em GROUP BY vec_id) SELECT vec_id, a.i - b.i AS lag, round(sum((a.value - m1) * (b.value - m2)) / sqrt(any_value(e1) * any_value(e2)), 4) + 0.0 AS score FROM a JOIN b USING (vec_id) JOIN ms USING (vec_id) GROUP BY vec_id, lag")
def cross_corr(spark, sf):
    w = waves(spark, sf)
    return out(correlate.cross_correlation(w.where("i < 32"), w.where("i >= 32").withColumn("i", F.col("i") - 32), ["vec_id"], 31))


@query(f"""WITH {E}, l AS (SELECT label, i, avg(value) AS v FROM em JOIN embeddings USING (vec_id) GROUP BY label, i), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT label, sum(i * abs(v)) / sum(abs(v)) AS centroid, sum(abs(v)) FILTER (i >= 48) AS high FROM l GROUP BY label), k AS (SELECT * FROM n JOIN m USING (label)),
c AS (SELECT x.label AS a, y.label AS b, avg(abs(x.v - y.v)) AS mae, corr(x.v, y.v) AS r, sum(x.v * y.v) / sqrt(sum(x.v * x.v) * sum(y.v * y.v)) AS cs FROM l x JOIN l y ON x.i = y.i AND x.label < y.label GROUP BY ALL)
SELECT CAST(a AS BIGINT) AS label_1, CAST(b AS BIGINT) AS label_2, round(mae, 4) + 0.0 AS mae, round(r, 4) + 0.0 AS pearson_corr, round(cs, 4) + 0.0 AS cosine_sim, x.n - y.n AS veh_diff, round(x.centroid - y.centroid, 4) + 0.0 AS centroid_diff, round(x.high - y.high, 4) + 0.0 AS high_band_diff
FROM c JOIN k x ON x.label = a JOIN k y ON y.label = b""")
def spectrum_compare(spark, sf):
    w = waves(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    g = w.groupBy("label", "i").agg(F.avg("value").alias("v"))
    # labels are few: a row for each label and bin
    p = g.withColumnsRenamed({"label": "label_1", "v": "v_1"}).join(g.withColumnsRenamed({"label": "label_2", "v": "v_2"}), "i").where("label_1 < label_2")
    p = p.groupBy("label_1", "label_2").agg(*stats.compare("v_1", "v_2"))
    count = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own = g.groupBy("label").agg(F.try_divide(F.sum(F.col("i") * F.abs("v")), F.sum(F.abs("v"))).alias("centroid"), F.sum(F.when(F.col("i") >= 48, F.abs("v"))).alias("high")).join(count, "label")
    side = lambda k: own.select(*(F.col(c).alias(f"{c}_{k}") for c in own.columns))
    p = p.join(side(1), "label_1").join(side(2), "label_2")
    gap = lambda c: F.col(f"{c}_1") - F.col(f"{c}_2")
    return out(p.select("label_1", "label_2", "mae", "pearson_corr", "cosine_sim", gap("n").alias("veh_diff"), gap("centroid").alias("centroid_diff"), gap("high").alias("high_band_diff")))


@query(f"WITH {E} SELECT vec_id, bin, round(pow(sum(value * cos(2 * pi() / 64 * ((i * bin) % 64))), 2) + pow(sum(value * sin(2 * pi() / 64 * ((i * bin) % 64))), 2), 4) + 0.0 AS power FROM em, (SELECT unnest(range(33)) AS bin) GROUP BY vec_id, bin")
def dft_power(spark, sf):
    return out(spectral.dft_power(waves(spark, sf), ["vec_id"], 64))


@query(f"WITH {E}, p AS (SELECT vec_id, bin * 100 / 64 AS freq, pow(sum(value * cos(2 * pi() / 64 * ((i * bin) % 64))), 2) + pow(sum(value * sin(2 * pi() / 64 * ((i * bin) % 64))), 2) AS power FROM em, (SELECT unnest(range(33)) AS bin) GROUP BY vec_id, bin), b AS (SELECT *, CASE WHEN freq < 3 THEN 0 WHEN freq < 8 THEN 1 ELSE 2 END AS b FROM p), t AS (SELECT *, (freq - lag(freq) OVER (PARTITION BY vec_id, b ORDER BY freq)) * (power + lag(power) OVER (PARTITION BY vec_id, b ORDER BY freq)) / 2 AS a, (freq - lag(freq) OVER (PARTITION BY vec_id ORDER BY freq)) * (power + lag(power) OVER (PARTITION BY vec_id ORDER BY freq)) / 2 AS al FROM b) SELECT vec_id, round(sum(freq * power) / sum(power), 4) AS centroid, round(coalesce(sum(a) FILTER (b = 0), 0), 4) + 0.0 AS low_band, round(coalesce(sum(a) FILTER (b = 1), 0), 4) + 0.0 AS mid_band, round(coalesce(sum(a) FILTER (b = 2), 0), 4) + 0.0 AS high_band, round(coalesce(sum(al), 0), 4) + 0.0 AS total FROM t GROUP BY vec_id")
def spectral_bands(spark, sf):
    p = spectral.dft_power(waves(spark, sf), ["vec_id"], 64).withColumn("freq", F.col("bin") * 100 / 64)
    return out(spectral.bands(p, ["vec_id"]))


@query()
def welch_psd(spark, sf):
    return out(spectral.welch(signal(spark, sf), KEY, size=256), 6)


@query()
def spectrogram(spark, sf):
    d = spectral.spectrogram(signal(spark, sf), KEY)
    return out(d.withColumn("power_db", S.decibel(F.col("power"))), 6)


@query()
def spectral_peaks(spark, sf):
    return out(spectral.spectral_peaks(spectral.welch(signal(spark, sf), KEY, size=256), KEY, distance=4), 6)


@query()
def bandpass(spark, sf):
    return out(spectral.bandpass(signal(spark, sf), KEY), 6)


@query()
def spline_reconstruct(spark, sf):
    d = spectral.reconstruct(signal(spark, sf), KEY, 4)
    return out(d.groupBy("sensor").agg(stats.rmse("value", "rebuilt").alias("rmse"), stats.snr("value", "rebuilt").alias("snr")), 6)


@query()
def freq_anomaly(spark, sf):
    return out(spectral.anomaly(signal(spark, sf), KEY), 6)


@query()
def event_spectra(spark, sf):
    d = signal(spark, sf)
    ev = events.triggers(d, KEY, 200.0, 10, 3)
    return out(spectral.event_spectra(events.samples_of(ev, d, KEY).select("sensor", "event", "i", "value"), ["sensor", "event"]), 6)


# --- clustering ---------------------------------------------------------------

FEATURES = [f"f{k}" for k in range(64)]


def _features(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))


@query("WITH f AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(64)) + " FROM embeddings) SELECT vec_id, " + ", ".join(f"round((f{k} - avg(f{k}) OVER ()) / stddev_pop(f{k}) OVER (), 4) + 0.0 AS f{k}" for k in range(64)) + " FROM f")
def standard_scale(spark, sf):
    return out(cluster.standard_scale(_features(spark, sf), FEATURES))


@query()
def pca(spark, sf):
    return out(cluster.pca(cluster.standard_scale(_features(spark, sf), FEATURES), FEATURES, 3).select("vec_id", "pca_1", "pca_2", "pca_3"), 6)


@query()
def kmeans(spark, sf):
    return cluster.kmeans(cluster.standard_scale(_features(spark, sf), FEATURES), FEATURES)[0].select("vec_id", "cluster")


@query()
def cluster_indices(spark, sf):
    d = _features(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    return out(cluster.indices(d, FEATURES, "label"), 6)


@query()
def dbscan(spark, sf):
    return cluster.dbscan(_features(spark, sf), "vec_id", FEATURES[:4], 0.12, 4)


# --- tracking -----------------------------------------------------------------

# users stand for eight positions of ten metres, event ids for seconds
D = "d AS (SELECT event_id, user_id % 8 * 10.0 AS x, user_id % 8 AS p, CAST(event_id AS DOUBLE) AS t FROM events)"


def _detections(spark, sf):
    d = table(spark, sf, "events").select("event_id", F.col("user_id").alias("sensor_id"), (F.col("user_id") % 8 * 10.0).alias("x"), F.col("event_id").cast("double").alias("t"))
    return tracking.detections(d)


def _saved_detections(spark, sf):
    return saved(_detections(spark, sf))  # gate, seeds, positions and what follows each read them


@query(f"WITH {D} SELECT a.event_id AS k, b.event_id AS j FROM d a JOIN d b ON b.p < a.p AND a.p - b.p <= 4 AND b.t BETWEEN a.t - (a.x - b.x) / 5 - 0.5 AND a.t - (a.x - b.x) / 50 + 0.5")
def range_gate(spark, sf):
    return tracking.gate(_detections(spark, sf)).select("k", "j")


@query(f"WITH {D}, v AS (SELECT a.event_id AS k, b.event_id AS j, a.t AS tk, a.x AS xk, (a.x - b.x) / (a.t - b.t) AS v FROM d a JOIN d b ON b.p < a.p AND a.p - b.p <= 4 AND b.t BETWEEN a.t - (a.x - b.x) / 5 - 0.5 AND a.t - (a.x - b.x) / 50 + 0.5 AND a.t > b.t), w AS (SELECT *, CAST(sum(CASE WHEN v - pv <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY v, j) AS BIGINT) AS cluster FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY v, j) AS pv FROM v WHERE v BETWEEN 5 AND 50)) SELECT k, cluster, round(avg(v), 4) AS u0, count(*) + 1 AS n FROM w GROUP BY k, cluster HAVING abs(avg(v) - 16.7) <= 8")
def seeds(spark, sf):
    d = tracking.seeds(_detections(spark, sf)).select("k", "cluster", "u0", F.size("dids").alias("n"))
    return out(d)


@query()
def track_extend(spark, sf):
    d = _detections(spark, sf)
    t = tracking.extend(tracking.seeds(d), d, 30.0)
    return out(t.select("track", "u", "score", F.size("dids").alias("n")))


@query()
def track_steps(spark, sf):
    d = _saved_detections(spark, sf)
    return out(tracking.extend(tracking.seeds(d), d, 30.0, steps=True))


@query()
def track_dedup(spark, sf):
    d = _detections(spark, sf)
    return tracking.overlap_dedup(tracking.extend(tracking.seeds(d), d, 30.0)).select("track", F.size("dids").cast("long").alias("n"))


@query()
def jpda(spark, sf):
    d = _saved_detections(spark, sf)
    p = tracking.jpda(tracking.overlap_dedup(tracking.extend(tracking.seeds(d), d, 30.0)), d)
    return out(tracking.hard(p), 6)


def _vehicles(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vehicle"), (F.col("o_orderkey") * 7.0).alias("entry"), (15 + F.col("o_custkey") % 15).cast("double").alias("v_est"))
    return o.withColumns({"v_min": F.col("v_est") - 10 / 3.6, "v_max": F.col("v_est") + 10 / 3.6})


def _sensor_events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("sensor"), F.col("event_id").alias("event"), (F.col("event_id") * 11.0).alias("t"), (F.length("event_type") * 100.0).alias("pos"))


WIM = "v AS (SELECT o_orderkey AS vehicle, o_orderkey * 7.0 AS entry, 15 + o_custkey % 15 - 10 / 3.6 AS lo, 15 + o_custkey % 15 + 10 / 3.6 AS hi FROM orders), e AS (SELECT event_type AS sensor, event_id AS event, event_id * 11.0 AS t, length(event_type) * 100.0 AS pos FROM events), z AS (SELECT sensor, event, vehicle, t, entry + ((pos + 2300) / hi + (pos + 2300) / lo) / 2 AS mu, ((pos + 2300) / lo - (pos + 2300) / hi) / 2 AS sg FROM v, e), g AS (SELECT sensor, event, vehicle, exp(-0.5 * pow((t - mu) / sg, 2)) AS score FROM z WHERE exp(-0.5 * pow((t - mu) / sg, 2)) > 1e-15)"


@query(f"WITH {WIM} SELECT sensor, event, vehicle, round(score, 4) AS score FROM g")
def wim_gaussian(spark, sf):
    return out(tracking.wim_gaussian(_vehicles(spark, sf), _sensor_events(spark, sf)).where("score > 1e-15"))


@query(f"WITH {WIM} SELECT sensor, event, first(vehicle ORDER BY round(score, 9) DESC, vehicle) AS vehicle FROM g GROUP BY sensor, event")
def ownership(spark, sf):
    s = tracking.wim_gaussian(_vehicles(spark, sf), _sensor_events(spark, sf)).where("score > 1e-15").withColumn("score", F.round("score", 9))
    return tracking.ownership(s).select("sensor", "event", "vehicle")


@query()
def tracker_temporal(spark, sf):
    return out(tracking.temporal_tracker(_vehicles(spark, sf), _sensor_events(spark, sf), 600.0))


@query()
def dual_score(spark, sf):
    return out(tracking.dual_score(_vehicles(spark, sf), _sensor_events(spark, sf)), 6)


@query()
def propagated_score(spark, sf):
    return out(tracking.propagated(_vehicles(spark, sf), _sensor_events(spark, sf)), 6)


# --- reshaping and sets -------------------------------------------------------


CHANNELS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {CTE} SELECT user_id, " + ", ".join(f"max(CASE WHEN channel = '{s}' THEN round(value, 4) END) AS {s}" for s in CHANNELS) + " FROM s GROUP BY user_id")
def pivot_peaks(spark, sf):
    return out(raw(spark, sf).groupBy("user_id").pivot("channel", CHANNELS).agg(F.max("value")))


@query("WITH p AS (SELECT vec_id, CAST(unnest(range(64)) AS VARCHAR) AS n, unnest(embedding) AS v FROM embeddings) SELECT vec_id, 'f' || n AS name, round(CAST(v AS DOUBLE), 4) + 0.0 AS value FROM p")
def unpivot_peaks(spark, sf):
    return out(_features(spark, sf).unpivot(["vec_id"], FEATURES, "name", "value"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)")
def set_operations(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    n = lambda part, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n("both", a.intersect(b)).unionByName(n("first", a.subtract(b))).unionByName(n("all", a.union(b).distinct()))


# --- reports ------------------------------------------------------------------


@query(f"WITH {CTE}{TRIGGER}, z AS (SELECT split_part(sensor, '/', 1) AS channel, (end_idx - start_idx) * CAST(0.01 AS DOUBLE) AS s FROM ev) SELECT channel, count(*) AS n, round(min(s), 4) AS shortest, round(max(s), 4) AS longest, round(avg(s), 4) AS mean, round(quantile_cont(s, 0.5), 4) AS median FROM z GROUP BY channel")
def event_statistics(spark, sf):
    ev = events.triggers(signal(spark, sf), KEY, 200.0, 10, 3).withColumn("channel", F.split_part("sensor", F.lit("/"), F.lit(1)))
    return out(reports.event_statistics(ev, ["channel"], 0.01))


@query(f"WITH {CTE}, b AS (SELECT min(ts) AS t0 FROM events) SELECT channel, round(min(date_diff('microsecond', t0, ts) / 1e6), 4) AS first_s FROM s, b WHERE abs(value) >= 150 GROUP BY channel")
def first_activation(spark, sf):
    t0 = table(spark, sf, "events").agg(F.min("ts")).first()[0]
    d = raw(spark, sf).where(F.abs("value") >= HIT).withColumn("s", F.timestamp_diff("MICROSECOND", F.lit(t0).cast("timestamp_ntz"), F.col("ts")) / 1e6)
    return out(reports.first_activation(d, ["channel"], "s"))


@query(f"WITH {B} SELECT count(*) AS n, min(th) AS lo, max(th) AS hi, round(avg(th), 6) AS mean FROM t")
def threshold_report(spark, sf):
    return out(reports.range_report(_thresholds(spark, sf), "trigger_threshold"), 6)


@query("SELECT name, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS lo, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS hi FROM (SELECT 'o_totalprice' AS name, o_totalprice * 0.980665::DOUBLE AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey * 0.980665::DOUBLE FROM orders) GROUP BY name")
def describe(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_totalprice") * COUNT).alias("o_totalprice"), (F.col("o_custkey") * COUNT).alias("o_custkey"))
    return out(reports.describe(o, ["o_totalprice", "o_custkey"]))


CROSS = f"""{T}, cl AS (SELECT datetime, total AS total_classi FROM tc WHERE minute(datetime) <> 0), co AS (SELECT datetime, Car + Truck AS total_lanes FROM tc WHERE minute(datetime) <> 15), tr AS (SELECT datetime, Van + Bus AS transits FROM tc WHERE minute(datetime) <> 30),
x AS (SELECT datetime, total_classi, total_lanes, transits, total_classi - total_lanes AS classi_corsie, total_classi - transits AS classi_transiti FROM cl FULL JOIN co USING (datetime) FULL JOIN tr USING (datetime))"""


@query(f"WITH {CROSS} SELECT name, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS nulls FROM (SELECT 'total_classi' AS name, total_classi AS v FROM x UNION ALL SELECT 'total_lanes', total_lanes FROM x UNION ALL SELECT 'transits', transits FROM x) GROUP BY name")
def null_counts(spark, sf):
    return reports.null_counts(cross_validation(spark, sf), ["total_classi", "total_lanes", "transits"])


@query(f"WITH {CROSS} SELECT name, count(*) FILTER (v = 0) AS equal, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS std, round(max(v), 4) AS hi, round(min(v), 4) AS lo FROM (SELECT 'classi_corsie' AS name, classi_corsie::DOUBLE AS v FROM x UNION ALL SELECT 'classi_transiti', classi_transiti::DOUBLE FROM x) GROUP BY name")
def discrepancies(spark, sf):
    return out(reports.differences(cross_validation(spark, sf), ["classi_corsie", "classi_transiti"]))


@query(f"WITH {T}, w AS (SELECT datetime, date, total * 0.37::DOUBLE AS v FROM tc) SELECT date, round(avg(v), 4) AS mean, round(max(v), 4) AS hi, round(min(v), 4) AS lo, round(stddev_samp(v), 4) AS std, round(sum(v), 4) AS total, first(datetime ORDER BY v DESC, datetime) AS hi_at, first(datetime ORDER BY v, datetime) AS lo_at FROM w GROUP BY date")
def day_statistics(spark, sf):
    return out(reports.day_statistics(quarters(spark, sf).withColumn("v", F.col("total") * 0.37), "v"))


@query(f"WITH {T} SELECT strftime(date, '%d/%m/%Y') AS date, count(*) AS records FROM tc GROUP BY date")
def records_per_date(spark, sf):
    return reports.records_per_date(quarters(spark, sf))


@query(f"WITH {T}, r AS (SELECT strftime(date, '%d/%m/%Y') AS date, count(*) AS records FROM tc GROUP BY tc.date) SELECT count(*) AS dates, min(date) AS first, max(date) AS last FROM r")
def date_range(spark, sf):
    return reports.date_range(reports.records_per_date(quarters(spark, sf)))


@query(f"WITH {T} SELECT datetime, total FROM tc WHERE strftime(date, '%d/%m/%Y') = '15/01/2024'")
def day_filter(spark, sf):
    return quarters(spark, sf).where(F.date_format("date", "dd/MM/yyyy") == "15/01/2024").select("datetime", "total")


@query("SELECT row, event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS row FROM events) WHERE row BETWEEN 300 AND 399")
def positional_slice(spark, sf):
    d = reports.rows_between(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 300, 400)
    return d.select(F.col("row").cast("long").alias("row"), "event_id", "ts")


@query("SELECT props_value, min(event_id) AS event_id FROM (SELECT user_id % 97 AS props_value, event_id FROM events) GROUP BY props_value")
def ordered_distinct(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 97).alias("props_value"), "event_id")
    return reports.ordered_distinct(e, "props_value", "event_id")


@query("WITH a AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS x FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS y FROM lineitem WHERE l_linenumber = 2) SELECT k, x, y FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) AS n FROM a) JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC) AS n FROM b) USING (k, n)")
def reversed_bind(spark, sf):
    o = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("x"))
    a, b = o.where("l_linenumber = 1").select("k", "x"), o.where("l_linenumber = 2").select("k", F.col("x").alias("y"))
    return reports.bind_reversed(a, b, ["k"], "x", "y").select("k", "x", "y")


@query("WITH a AS (SELECT date_trunc('hour', ts) AS t, count(*) AS clicks FROM events WHERE event_type = 'click' AND user_id % 3 = 0 GROUP BY t), b AS (SELECT date_trunc('hour', ts) AS t, count(*) AS errors FROM events WHERE event_type = 'error' AND user_id % 3 = 1 GROUP BY t) SELECT t, clicks, errors FROM a FULL JOIN b USING (t)")
def isolated_merge(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    n = lambda kind, rest, name: e.where((F.col("event_type") == kind) & (F.col("user_id") % 3 == rest)).groupBy("t").agg(F.count(F.lit(1)).alias(name))
    return reports.isolated_merge(n("click", 0, "clicks"), n("error", 1, "errors"), "t")


@query(f"WITH {T}, l AS (SELECT datetime, total, strftime(datetime, '%d/%m/%Y %H:%M') || ' - ' || strftime(datetime + INTERVAL 15 MINUTE, '%H:%M') AS label FROM tc), r AS (SELECT 0::BIGINT AS range_id, ' 08:00 - 08:15' AS a, '15/01/2024' AS d UNION ALL SELECT 1, ' 17:30 - 17:45', '16/01/2024' UNION ALL SELECT 2, ' 25:00', '15/01/2024') SELECT range_id, CAST(coalesce(first(total ORDER BY datetime) FILTER (total IS NOT NULL), 0) AS BIGINT) AS total FROM r LEFT JOIN l ON contains(label, a) AND contains(label, d) GROUP BY range_id")
def vehicle_counts(spark, sf):
    end = F.timestamp_add("MINUTE", F.lit(15), F.col("datetime"))
    label = F.concat(F.date_format("datetime", "dd/MM/yyyy HH:mm"), F.lit(" - "), F.date_format(end, "HH:mm"))
    q = quarters(spark, sf).select(F.col("datetime").alias("row"), label.alias("label"), "total")
    ranges = spark.createDataFrame([(0, " 08:00 - 08:15", "15/01/2024"), (1, " 17:30 - 17:45", "16/01/2024"), (2, " 25:00", "15/01/2024")], "range_id long, range_text string, day_text string")
    return reports.vehicle_counts(q, ranges, ["total"])


@query(f"WITH {T} SELECT day_type, CAST(sum(Truck + Bus) AS BIGINT) AS total, round(avg(Truck + Bus), 4) AS mean, round(sum(Truck) * 100.0 / sum(Truck + Bus), 4) AS truck_pct FROM tc GROUP BY day_type")
def heavy_patterns(spark, sf):
    return out(reports.heavy_patterns(traffic.load_columns(quarters(spark, sf))))


@query(f"WITH {T} SELECT day_type, round(avg(total) FILTER (hour BETWEEN 6 AND 9), 4) AS morning, round(avg(total) FILTER (hour BETWEEN 16 AND 19), 4) AS evening FROM tc GROUP BY day_type")
def rush_hours(spark, sf):
    return out(reports.rush_hours(quarters(spark, sf), "total"))


@query(f"WITH {T} SELECT isodow(datetime) - 1 AS weekday, sum(total) / 4 AS total, sum(Truck) / 4 AS Truck FROM tc GROUP BY isodow(datetime)")
def weekday_profile(spark, sf):
    return out(reports.weekday_profile(quarters(spark, sf), ["total", "Truck"]))


@query(f"WITH {T}, g AS (SELECT hour, {', '.join(f'sum({c}) AS {c}' for c in CLASSES)} FROM tc GROUP BY hour) SELECT hour, {', '.join(f'round({c} * 100.0 / (Car + Bus + Motorbike + Truck + Van), 4) AS {c}' for c in CLASSES)} FROM g")
def hour_class_shares(spark, sf):
    return out(reports.row_shares(quarters(spark, sf), "hour", CLASSES))


@query(f"WITH {T} SELECT hour, round(avg((Truck + Bus) * total) FILTER (day_type = 'Weekday'), 4) AS Weekday, round(avg((Truck + Bus) * total) FILTER (day_type = 'Weekend'), 4) AS Weekend FROM tc GROUP BY hour")
def stress_pivot(spark, sf):
    d = traffic.load_columns(quarters(spark, sf)).groupBy("hour").pivot("day_type", ["Weekday", "Weekend"]).agg(F.avg("stress_score"))
    return out(d)


@query(f"WITH {T} SELECT datetime, total, round(avg(total) OVER (PARTITION BY date ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS ma FROM tc")
def traffic_moving_average(spark, sf):
    d = X.rolling_mean(quarters(spark, sf), ["date"], "datetime", "total", 4, centre=True)
    return out(d.select("datetime", "total", "ma"))


@query("WITH b AS (SELECT s_suppkey AS sensor_id, s_nationkey AS span, s_nationkey * 1000 + (s_suppkey // 2) * 2.5 AS dist, CASE WHEN s_suppkey % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM supplier) SELECT CAST(span AS BIGINT) AS span, side AS part, count(*) AS n, string_agg(CAST(sensor_id AS VARCHAR), ',' ORDER BY dist, sensor_id) AS ids FROM b GROUP BY span, side")
def bridge_by_side(spark, sf):
    side = F.when(F.col("sensor_id") % 2 == 0, "left").otherwise("right")
    return reports.by_axis(_sensors(spark, sf), side)


@query(r"""WITH l AS (SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS txt, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS num FROM events)
SELECT event_id, regexp_extract(txt, '(\d{1,2}:\d{2})', 1) AS clock, regexp_extract(txt, '(\d{2}/\d{2}/\d{4})', 1) AS day, CAST(split_part(regexp_extract(txt, '(\d{1,2}:\d{2})', 1), ':', 1) AS BIGINT) * 60 + CAST(split_part(regexp_extract(txt, '(\d{1,2}:\d{2})', 1), ':', 2) AS BIGINT) AS minutes, CASE WHEN regexp_matches(num, '^[0-9]+$') THEN CAST(num AS BIGINT) ELSE -1 END AS num, txt || ' vs ' || num AS label FROM l""")
def text_scalars(spark, sf):
    num = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id").cast("string"))
    d = table(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm").alias("txt"), num.alias("num"))
    clock = S.clock_text(F.col("txt"))
    return out(d.select("event_id", clock.alias("clock"), S.date_text(F.col("txt")).alias("day"), S.clock_minutes(clock).alias("minutes"), S.digits(F.col("num")).alias("num"), S.pair_label(F.col("txt"), F.col("num")).alias("label")))


@query("SELECT CAST(label AS BIGINT) AS cluster, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM embeddings GROUP BY label")
def cluster_distribution(spark, sf):
    return out(cluster.distribution(table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")))


@query(f"WITH {WIM}, n AS (SELECT sensor, event, vehicle, score / sum(score) OVER (PARTITION BY sensor, event) AS score FROM g WHERE score > 1e-3) SELECT sensor, event, vehicle, round(score, 4) AS score FROM n")
def event_normalised(spark, sf):
    s = tracking.wim_gaussian(_vehicles(spark, sf), _sensor_events(spark, sf)).where("score > 1e-3")
    return out(reports.normalised(s, ["sensor", "event"], "score"))


@query(f"WITH {WIM}, o AS (SELECT sensor, event, vehicle, round(score, 9) AS score FROM g), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM o WINDOW w AS (PARTITION BY sensor, event ORDER BY score DESC, vehicle)) SELECT sensor, event, round(score, 4) AS best, round(second, 4) AS second, coalesce(second >= 0.8 * score, false) AS ambiguous FROM r WHERE n = 1")
def ambiguous_events(spark, sf):
    s = tracking.wim_gaussian(_vehicles(spark, sf), _sensor_events(spark, sf)).where("score > 1e-15").withColumn("score", F.round("score", 9))
    return out(reports.ambiguous(s))


@query(f"WITH {WIM}, q AS (SELECT vehicle, sensor, event, event * 11.0 AS t FROM g WHERE score >= 0.05) SELECT vehicle, sensor, event, round(t, 4) AS t, round(t - min(t) OVER (PARTITION BY vehicle), 4) AS elapsed FROM q")
def progression_points(spark, sf):
    e = _sensor_events(spark, sf)
    s = tracking.wim_gaussian(_vehicles(spark, sf), e).join(e.select("sensor", "event", "t"), ["sensor", "event"])
    return out(reports.progression_points(s))


@query("WITH v AS (SELECT o_orderkey AS vehicle, o_orderkey * 7.0 AS entry, 15 + o_custkey % 15 - 10 / 3.6 AS lo, 15 + o_custkey % 15 + 10 / 3.6 AS hi FROM orders), p AS (SELECT DISTINCT event_type AS sensor, length(event_type) * 100.0 AS pos FROM events), m AS (SELECT vehicle, sensor, entry + ((pos + 2300) / hi + (pos + 2300) / lo) / 2 AS mu, ((pos + 2300) / lo - (pos + 2300) / hi) / 2 AS sg FROM v, p) SELECT vehicle, sensor, k, round(mu + (k - 4) * sg, 4) AS t, round(exp(-0.5 * pow(k - 4, 2)), 4) AS density FROM m, (SELECT unnest(range(9)) AS k)")
def gaussian_curves(spark, sf):
    places = _sensor_events(spark, sf).select("sensor", "pos").distinct()
    return out(reports.gaussian_curve(_vehicles(spark, sf), places, points=9))


@query()
def track_lines(spark, sf):
    d = _detections(spark, sf)
    t = tracking.extend(tracking.seeds(d), d, 30.0)
    return out(reports.track_lines(t.where("u is not null"), d.select("x")))


@query()
def propagated_unified(spark, sf):
    return out(reports.unified(tracking.propagated(_vehicles(spark, sf), _sensor_events(spark, sf), best=True)), 6)


@query()
def event_features_37(spark, sf):
    """The feature table of triggered events: moments, crossings, percentiles and the spectral part."""
    d = signal(spark, sf)
    ev = events.triggers(d, KEY, 200.0, 10, 3)
    return out(spectral.event_features(events.samples_of(ev, d, KEY).select("sensor", "event", "i", "value"), ["sensor", "event"]), 6)


@query()
def fft_round_trip(spark, sf):
    return out(spectral.round_trip(signal(spark, sf), KEY), 6)


@query()
def fft_magnitude(spark, sf):
    return out(spectral.fft_magnitude(signal(spark, sf), KEY), 6)


@query()
def welch_grid(spark, sf):
    return out(spectral.welch_grid(signal(spark, sf), KEY, sizes=[64, 128]), 6)
