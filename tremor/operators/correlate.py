"""Delays and speeds between sensors, and chains of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.operators import windows as X


def template_slide(templates: DataFrame, signal: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys, lag, score): cosine similarity of a template (k, t, start) at each lag of a signal (i, value).

    Lags go from 0 up to, but not including, ``max_lag``, and the last place that
    the template would fit into is not tried either.
    """
    n = templates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    t = templates.join(n, keys).join(size, keys).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag - 1))))
    t = t.where(F.col("start") + F.col("lag") < F.col("_size") - F.col("_n"))
    t = t.withColumn("i", F.col("start") + F.col("lag") + F.col("k"))
    g = t.join(signal, [*keys, "i"]).groupBy(*keys, "lag", "_n").agg(F.sum(F.col("t") * F.col("value")).alias("ab"), F.sum(F.col("t") * F.col("t")).alias("aa"), F.sum(F.col("value") * F.col("value")).alias("bb"), F.count(F.lit(1)).alias("_c")).where("_c = _n")
    norm = F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))
    return g.select(*keys, "lag", F.when(norm > 1e-10, F.col("ab") / norm).otherwise(0.0).alias("score"))


def best_lag(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the best score, the first of equals."""
    g = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("lag")).alias("n"))).alias("b"))
    return g.select(*keys, (-F.col("b.n")).alias("lag"), F.col("b.score").alias("score"))


def cross_correlation(a: DataFrame, b: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """(keys, lag, score) of two centred signals over the overlap, scaled by both norms; a positive lag means ``a`` is later."""
    own = lambda d, n: d.groupBy(*keys).agg(F.avg("value").alias(f"m{n}"), (F.count(F.lit(1)) * F.var_pop("value")).alias(f"e{n}"))
    left = a.withColumnRenamed("value", "x").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("_j", F.col("i") - F.col("lag"))
    d = left.join(b.select(*keys, F.col("i").alias("_j"), F.col("value").alias("y")), [*keys, "_j"]).join(own(a, 1), keys).join(own(b, 2), keys)
    g = d.groupBy(*keys, "lag", "e1", "e2").agg(F.sum((F.col("x") - F.col("m1")) * (F.col("y") - F.col("m2"))).alias("s"))
    return g.select(*keys, "lag", F.when(F.col("e1") * F.col("e2") > 1e-20, F.col("s") / F.sqrt(F.col("e1") * F.col("e2"))).otherwise(0.0).alias("score"))


def pair_speeds(lags: DataFrame, keys: list[str], dt: float = 0.01) -> DataFrame:
    """Speeds between neighbours in the order of distance, and over the whole way; lags are (dist, lag, score)."""
    w = X.by(keys, "dist")
    d = lags.withColumns({"step_m": F.col("dist") - F.lag("dist").over(w), "step_s": (F.col("lag") - F.lag("lag").over(w)) * dt})
    d = d.withColumn("speed", S.speed_kmh(F.col("step_s"), F.col("step_m")))
    return d.withColumn("plausible", (F.col("speed") > 5) & (F.col("speed") < 300))


def speed_summary(speeds: DataFrame, keys: list[str], lo: float = 20.0, hi: float = 200.0) -> DataFrame:
    """Mean and population deviation of the valid speeds, and a confidence from completeness, score and spread."""
    ok = F.col("speed").between(lo, hi)
    g = speeds.groupBy(*keys).agg(F.avg(F.when(ok, F.col("speed"))).alias("mean_speed"), F.stddev_pop(F.when(ok, F.col("speed"))).alias("std_speed"), F.avg("score").alias("corr"), F.try_divide(F.count_if(ok), F.count("speed")).alias("complete"))
    return g.withColumn("confidence", 0.3 * F.col("complete") + 0.4 * F.col("corr") + F.try_divide(F.lit(0.3), 1 + F.try_divide(F.col("std_speed"), F.col("mean_speed"))))


def segment_pairs(segments: DataFrame, idx: str) -> DataFrame:
    """Each pair of segments once: for the few segments of a report."""
    a = segments.select(*(F.col(c).alias(f"{c}_1") for c in segments.columns))
    b = segments.select(*(F.col(c).alias(f"{c}_2") for c in segments.columns))
    return a.join(b, F.col(f"{idx}_1") < F.col(f"{idx}_2"))


def chains(events: DataFrame, group: str, dt: float = 0.01, v_min: float = 60.0, v_max: float = 150.0, ratio: tuple[float, float] = (0.1, 3.0), least: float = 0.1) -> DataFrame:
    """(group, chain, place, event, t, score): events followed from sensor to sensor within a group (an hour, say).

    Events are (place, dist, event, t, amp, duration, waveform array).  Of the
    unused events in reach the most alike one goes on, the first of equals; it
    stays used if the chain fails later.  Only whole chains are returned.
    """
    kind = dict(events.dtypes)[group]

    def alike(x, y):
        n = min(len(x), len(y))
        if n < 10:
            return -1.0
        x, y = np.asarray(x[:n], float), np.asarray(y[:n], float)
        d = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.correlate(x, y, "full").max() / d) if d > 1e-10 else 0.0

    def run(pdf):
        places = [p for _, p in pdf.sort_values(["dist", "t"]).groupby("dist")]
        used, out, chain = set(), [], 0
        for a in places[0].itertuples() if len(places) > 1 else []:
            prev, rows = a, [(0, a.event, a.t, 1.0)]
            for k, p in enumerate(places[1:], 1):
                d = float(p.dist.iloc[0]) - float(prev.dist)
                best = None
                for c in p.itertuples():
                    if (k, c.event) in used or not prev.t + d / (v_max / 3.6) <= c.t <= prev.t + d / (v_min / 3.6) or not ratio[0] <= abs(c.amp) / (abs(a.amp) + 1e-10) <= ratio[1]:
                        continue
                    s = alike(prev.waveform, c.waveform)
                    if s >= least and (best is None or s > best[0]):
                        best = (s, c)
                if best is None:
                    break
                used.add((k, best[1].event))
                prev = best[1]
                rows.append((k, prev.event, prev.t, best[0]))
            if len(rows) == len(places):
                out += [(pdf[group].iloc[0], chain, *r) for r in rows]
                chain += 1
        return pd.DataFrame(out, columns=[group, "chain", "place", "event", "t", "score"])

    return events.groupBy(group).applyInPandas(run, f"{group} {kind}, chain bigint, place bigint, event bigint, t double, score double")
