import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremor.functions import signal as G
from tremor.operators import cluster, correlate, events, reports, spectral, tracking
from tremor.sources import files


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(4)
    rows = [(s, i, float(v)) for s, n in (("a", 300), ("b", 41), ("c", 1)) for i, v in enumerate(rng.normal(size=n) + np.sin(np.arange(n)))]
    return spark.createDataFrame(rows, "sensor string, i long, value double"), pd.DataFrame(rows, columns=["sensor", "i", "value"])


def test_fft_and_back(wave):
    d, p = wave
    r = spectral.round_trip(d, ["sensor"]).toPandas()
    assert np.allclose(r.value, r.back) and len(r) == len(p)
    m = spectral.fft_magnitude(d, ["sensor"]).toPandas()
    for s, x in p.groupby("sensor"):
        own = m[m.sensor == s].sort_values("bin")
        assert np.allclose(own.magnitude, np.abs(np.fft.rfft(x.value))) and np.allclose(own.freq, np.fft.rfftfreq(len(x), 0.01))


def test_welch_grid_equals_the_kernel(wave):
    d, p = wave
    r = spectral.welch_grid(d, ["sensor"], sizes=[32, 64]).toPandas()
    for (s, w, n), g in r.groupby(["sensor", "window", "size"]):
        f, q = G.periodograms(p[p.sensor == s].value.to_numpy(), 100.0, n, n // 2, w)
        g = g.sort_values("freq")
        assert np.allclose(g.power, q.mean(0)[f <= 20], equal_nan=True) and np.allclose(g.freq, f[f <= 20])
    assert set(r.window) == {"hann", "hamming", "blackman", "flattop", "bartlett"}


def test_spectral_queries_on_signals(wave):
    d, p = wave
    psd = spectral.welch(d, ["sensor"], size=64).toPandas()
    f, q = G.periodograms(p[p.sensor == "a"].value.to_numpy(), 100.0, 64, 32)
    assert np.allclose(psd[psd.sensor == "a"].sort_values("freq").power, q.mean(0)[f <= 20])
    s = spectral.spectrogram(d, ["sensor"], size=64, overlap=16).toPandas()
    assert s[s.sensor == "a"].segment.nunique() == (300 - 64) // 48 + 1
    again = spectral.reconstruct(d.where("sensor = 'a'"), ["sensor"], 1).toPandas()
    assert np.allclose(again.value, again.rebuilt)
    same = spectral.anomaly(d, ["sensor"], factor=1.0).toPandas().sort_values(["sensor", "i"])
    assert np.allclose(same.value, p.sort_values(["sensor", "i"]).value)


def test_event_features_equal_numpy(wave):
    d, p = wave
    r = spectral.event_features(d.withColumn("event", F.lit(1)), ["sensor", "event"]).toPandas().set_index("sensor")
    x = p[p.sensor == "a"].value.to_numpy()
    z = (x - x.mean()) / x.std()
    want = {"mean": x.mean(), "std": x.std(), "var": x.var(), "range": np.ptp(x), "rms": np.sqrt((x * x).mean()), "skew": (z**3).mean(), "kurt": (z**4).mean() - 3, "p25": np.percentile(x, 25), "p90": np.percentile(x, 90), "crest": np.abs(x).max() / np.sqrt((x * x).mean()), "zcr": (np.diff(np.sign(x)) != 0).sum() / len(x), **G.spectral_features(x)}
    for k, v in want.items():
        assert r.loc["a", k] == pytest.approx(v), k
    assert len(r.columns) >= 37 and r.loc["c", "n"] == 1


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.2, (20, 2)) for c in range(0, 14, 2)])
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, p double, q double")
    out, curve = cluster.kmeans(d, ["p", "q"], most=9, starts=3)
    assert [k for k, _, _ in curve] == list(range(2, 10)) and out.select("cluster").distinct().count() == 7
    labels = out.orderBy("id").toPandas().cluster.to_numpy()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        own = labels == labels[i]
        a = far[i][own].sum() / (own.sum() - 1)
        b = min(far[i][labels == c].mean() for c in set(labels) - {labels[i]})
        s.append((b - a) / max(a, b))
    assert cluster.euclidean_silhouette(out, ["p", "q"], "cluster", block=37).first()[0] == pytest.approx(np.mean(s))
    assert cluster.distribution(out).agg(F.sum("pct")).first()[0] == pytest.approx(100)
    p = cluster.pca(d, ["p", "q"], 3).toPandas()
    c = x - x.mean(0)
    first = c @ np.linalg.svd(c, full_matrices=False)[2][0]
    own = p.sort_values("id").pca_1.to_numpy()
    assert np.allclose(np.abs(own - own.mean()), np.abs(first)) and (p.pca_3 == 0).all()
    ix = cluster.indices(out, ["p", "q"], "cluster").first()
    assert ix.davies_bouldin < 0.5 and ix.calinski_harabasz > 100


def test_template_lags_end_before_their_bounds(spark):
    w = spark.createDataFrame([("a", i, float(i % 5 + 1)) for i in range(20)], "k string, i long, value double")
    t = spark.createDataFrame([("a", j, float(j + 1), 3) for j in range(5)], "k string, k0 long, t double, start long").withColumnsRenamed({"k": "sig", "k0": "k"})
    w = w.withColumnRenamed("k", "sig")
    lags = lambda most: sorted(r.lag for r in correlate.template_slide(t, w, ["sig"], most).collect())
    assert lags(4) == [0, 1, 2, 3] and lags(100) == list(range(12))  # 3 + lag < 20 - 5
    best = correlate.best_lag(correlate.template_slide(t, w, ["sig"], 100), ["sig"]).first()
    assert best.lag == 2 and best.score == pytest.approx(1.0)


def test_a_track_pays_for_each_position_without_a_detection(spark):
    rows = [(k, k, float(k * 10), k * 10 / 16.7) for k in range(8)] + [(100 + k, 50 + k, float(80 + k * 10), 5000.0) for k in range(4)]
    d = tracking.detections(spark.createDataFrame([(i, s, t, x) for i, s, x, t in rows], "event_id long, sensor_id long, t double, x double"))
    seeds = tracking.seeds(d).where("k = 4")
    near, far = (tracking.extend(seeds, d, r).first() for r in (30.0, 100000.0))
    assert near.dids == far.dids == list(range(8)) and near.score == pytest.approx(far.score)
    steps = tracking.extend(seeds, d, 30.0, steps=True).collect()
    missed = [s for s in steps if s.hit is None]
    assert [s.x for s in missed] == [80.0, 90.0, 100.0, 110.0]
    assert missed[-1].score - missed[0].score == pytest.approx(3 * math.log(0.05))


def wim(spark, entries):
    return spark.createDataFrame([(k, e, 20.0, 17.0, 23.0) for k, e in enumerate(entries)], "vehicle long, entry double, v_est double, v_min double, v_max double")


def test_reach_is_a_distance_in_time(spark):
    ev = spark.createDataFrame([("s", k, t, 100.0) for k, t in enumerate((100.0, 500.0, 661.0, 1180.0))] + [("t", 9, 120.0, 400.0)], "sensor string, event long, t double, pos double")
    v = wim(spark, [10.0, 590.0, 5000.0])
    got = tracking.propagated(v, ev, reach_s=600.0).toPandas()
    own = {k: sorted(g[g.sensor == "s"].event.dropna().astype(int)) for k, g in got.groupby("vehicle")}
    assert own == {0: [0, 1], 1: [2, 3], 2: []}
    # sensors without events in reach stay, and so do vehicles
    assert got[got.vehicle == 2].sensor.tolist() == ["s", "t"] and got[got.vehicle == 2].score.isna().all()
    t = tracking.temporal_tracker(v, ev, reach_s=600.0).toPandas()
    assert sorted(t.vehicle) == [0, 1, 2]
    # no event at the first sensor: no second score anywhere
    d = tracking.dual_score(wim(spark, [0.0]), ev.where("sensor = 't' or t > 5000"), reach_s=600.0).toPandas()
    both = ev.unionByName(spark.createDataFrame([("s", 50, 9000.0, 100.0)], ev.schema))
    none = tracking.dual_score(wim(spark, [700.0]), both.where("event in (9, 50)"), reach_s=600.0).toPandas()
    assert d.score_b.isna().all() and none.empty


def test_gaussian_scores_keep_far_events(spark):
    ev = spark.createDataFrame([("s", k, float(t), 0.0) for k, t in enumerate(range(0, 400, 10))], "sensor string, event long, t double, pos double")
    got = {r.event: r.score for r in tracking.wim_gaussian(wim(spark, [0.0]), ev).collect()}
    a, b = 2300 / 23, 2300 / 17
    for k in range(40):
        want = math.exp(-0.5 * ((k * 10 - (a + b) / 2) / ((b - a) / 2)) ** 2)
        assert got.get(k, 0.0) == pytest.approx(want, abs=1e-15)


def test_tables_of_peaks_weights_and_the_bridge(spark, tmp_path):
    p = spark.createDataFrame([("v1", "2025-03-02 08:00:00", "2025-01-01 10:00:05.250000|1.5;2025-01-01 10:00:06.125|x;bad|2", None), ("v2", "2025-03-02 08:00:00", "2025-01-01 10:00:05.250000|9", "")], "vehicle_id string, original_timestamp string, s1_dominant_peaks string, s2_dominant_peaks string")
    assert files.peak_sensors(p.columns) == ["s1", "s2"] and files.peak_sensors(p.columns, wanted=["s2"]) == ["s2"]
    got = files.read_peaks(p)
    assert sorted((r.vehicle_id, r.ts.isoformat(), r.amp) for r in got.collect()) == [("v1", "2025-03-02T10:00:05.250000", 1.5), ("v1", "2025-03-02T10:00:06.125000", None), ("v2", "2025-03-02T10:00:05.250000", 9.0)]
    assert {(r.vehicle_id, r.ts.microsecond) for r in files.sensor_events(got).collect()} == {("v1", 250000), ("v1", 125000)}
    back = files.write_peaks(got.where("amp is not null"), ["s1"]).where("vehicle_id = 'v1'").first()
    assert back.s1_dominant_peaks == "2025-03-02 10:00:05.250000|1.5"
    w = spark.createDataFrame([("02/03/2025 10:15", 72.0), ("02/03/2025 10:16", None), ("2025-02-03 10:17:30.5", 36.0)], "StartTimeStr string, Velocity double").coalesce(1)
    r = files.wim_entries(w, tolerance=40.0, anchor=-2300.0).orderBy("vehicle").collect()
    assert [(x.vehicle, x.v_est) for x in r] == [(0, 20.0), (2, 10.0)] and r[0].v_min == pytest.approx(20 - 40 / 3.6) and r[0].anchor == -2300
    many = files.numbered(spark.range(100).repartition(7), "n").select("n").collect()
    assert sorted(x.n for x in many) == list(range(100))
    (tmp_path / "b.csv").write_text("﻿vertical,SPAN,DIST_M,sensor_id,note\n0A_z,P1,12.5,7,x\n0B_z,P2,,n/a,y\n", encoding="utf-8")
    b = files.read_positions(spark, str(tmp_path / "b.csv")).orderBy("row").collect()
    assert (b[0].channel, b[0].span, b[0].dist, b[0].sensor_id, b[0].extra, b[0].side) == ("0A_z", "P1", 12.5, 7, {"note": "x"}, None) and (b[1].dist, b[1].sensor_id) == (None, -1)
    files.write_report(spark.createDataFrame([("a line",)], "value string"), str(tmp_path / "r"))
    files.write_report(spark.createDataFrame([("more",)], "value string"), str(tmp_path / "r"), append=True)
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_vehicle_event_table(spark):
    rng = random.Random(3)
    start = pd.Timestamp("2025-03-02 10:58:00")
    wim_rows = spark.createDataFrame([(1, start.to_pydatetime())], "vehicle_id long, start_ts timestamp_ntz")
    rows = [(s, (start + pd.Timedelta(seconds=k)).to_pydatetime(), rng.random() + 5) for s in ("a", "b") for k in range(0, 600, 10)]
    d = events.boundary_events(wim_rows, spark.createDataFrame(rows, "sensor string, ts timestamp_ntz, value double")).toPandas()
    assert len(d) == 2 * 31 and d.groupby("sensor").value.mean().abs().max() < 1e-9 and d.groupby("sensor").i.max().tolist() == [30, 30]
    pts = spark.createDataFrame([(1, "a", start.to_pydatetime(), (start + pd.Timedelta(seconds=2)).to_pydatetime()), (1, "b", (start + pd.Timedelta(seconds=4)).to_pydatetime(), (start + pd.Timedelta(seconds=5)).to_pydatetime())], "vehicle_id long, sensor string, first_ts timestamp_ntz, peak_ts timestamp_ntz")
    assert [r.elapsed for r in events.progression(pts).orderBy("sensor").collect()] == [2.0, 5.0]


def test_small_reports(spark):
    t = spark.createDataFrame([("t1", 0.0, 10.0, 1.0, [1, 2, 3]), ("t2", 5.0, 20.0, 2.0, [3, 4]), ("t3", 0.0, 10.0, 0.5, [7, 8, 9])], "track string, a double, u double, score double, dids array<long>")
    assert reports.longest_track(t).first().track == "t1" and reports.longest_track(t, 2).first().track == "t3"
    truth = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 100)], "vehicle long, event_id long")
    c = {r.vehicle: (r.n, r.hits, r.best_track) for r in reports.coverage(t, truth).collect()}
    assert c == {1: (3, 2, "t1"), 2: (1, 0, None)}
    lines = reports.track_lines(t, spark.createDataFrame([(0.0,), (20.0,)], "x double")).collect()
    assert {(r.track, r.x): r.t for r in lines}["t2", 20.0] == 6.0
    m = reports.merge_zoom(spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.05), (2, "a", 0.0), (3, "a", 0.0), (3, "b", 9.0)], "event_id long, track string, t_hat double"), 0.1)
    assert {r.event_id for r in m.collect()} == {1}
    truth2 = spark.createDataFrame([(1, {"10.0": 3.5, "20.0": 4.0})], "vehicle_id long, times map<string,double>")
    assert [(r.x, r.t) for r in reports.truth_lines(truth2, [20.0]).collect()] == [(20.0, 4.0)]
    v = reports.metric_by_vehicles(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 7.0)], "time string, centroid double"), spark.createDataFrame([("a", 5), ("b", 5)], "time string, vehicles long"), "time", "centroid")
    assert [(r.vehicles, r.n, r["mean"]) for r in v.collect()] == [(5, 2, 2.0)]
