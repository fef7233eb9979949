import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import scalars as S
from tremor.functions import signal as G
from tremor.operators import bridge, cluster, correlate, events, samples, stats, tracking, traffic
from tremor.operators import windows as X
from tremor.sources import files


def signals(spark, rows):
    return spark.createDataFrame([(s, i, float(v)) for s, vs in rows.items() for i, v in enumerate(vs)], "sensor string, i long, value double")


def noisy(seed, n=60):
    r = random.Random(seed)
    return [r.choice([0, 0, 0, 0.5, -0.5, 1, -2]) for _ in range(n)]


def test_mask_equals_scan(spark):
    rows = {f"s{k}": noisy(k) for k in range(8)}
    got = {(r.sensor, r.i): r.active for r in events.activity_mask(signals(spark, rows), ["sensor"], F.lit(1.0), 4, 2).collect()}
    for s, vs in rows.items():
        want = [False] * len(vs)
        for i, v in enumerate(vs):
            if abs(v) >= 1:
                for k in range(max(0, i - 2), min(len(vs), i + 4)):
                    want[k] = True
        assert [got[s, i] for i in range(len(vs))] == want


def test_triggers_equal_scan(spark):
    rows = {f"s{k}": noisy(k) for k in range(8)}
    w, p = 5, 2
    got = {}
    for r in events.triggers(signals(spark, rows), ["sensor"], 1.0, w, p).orderBy("sensor", "event").collect():
        got.setdefault(r.sensor, []).append((r.start_idx, r.end_idx, r.n_triggers))
    for s, vs in rows.items():
        want, i, n = [], 0, len(vs)
        while i < n:
            if abs(vs[i]) >= 1:
                start, end, hits, k = max(0, i - p), min(n, i + w), 1, i + 1
                while k < end:
                    if abs(vs[k]) >= 1 and min(n, k + w) > end:
                        end, hits = min(n, k + w), hits + 1
                    k += 1
                want.append((start, end, hits))
                i = end
            else:
                i += 1
        assert got.get(s, []) == want


def test_box_smooth_mirrors_borders(spark):
    vs = [1.0, -2, 3, -4, 5, 6]
    got = [r.env for r in X.box_smooth(signals(spark, {"a": vs}), ["sensor"], "value", 4).orderBy("i").collect()]
    a = np.abs(vs)
    pad = np.concatenate([a[:2][::-1], a, a[-2:][::-1]])
    assert got == pytest.approx([pad[k : k + 4].mean() for k in range(6)])


def test_peaks_take_the_earliest_of_equals(spark):
    d = signals(spark, {"a": [0, 1, 3, 3, 1, 0, -3, 0]}).withColumn("active", F.col("i").between(1, 6))
    r = events.peaks(d, ["sensor"]).first()
    assert (r.first_idx, r.first_value, r.peak_idx, r.peak_value) == (2, 3.0, 2, 3.0)
    one = signals(spark, {"a": [5]}).withColumn("active", F.lit(True))
    assert events.peaks(one, ["sensor"]).first().peak_idx == 0


def test_interpolation_and_gaps(spark):
    d = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, None)], "sensor string, i long, value double")
    assert [r.value for r in X.interpolate(d, ["sensor"], "value").orderBy("i").collect()] == [2, 2, 4, 6, 6]
    g = X.gap_islands(signals(spark, {"a": [0, 1, 3, 3.5, 9]}), ["sensor"], "value", 2.0)
    assert [r.run for r in g.orderBy("value").collect()] == [1, 1, 1, 1, 2]


def test_labels_and_literals(spark):
    d = spark.createDataFrame([("Sab - 01/02/2025 0:15 - 0:30", " 12\n", "2025-31-01 10:00:00", "[1, 2]"), ("x", "", None, None)], "a string, b string, c string, d string")
    r = d.select(S.interval_label(F.col("a")).alias("l"), S.number(F.col("b")).alias("n"), S.event_time(F.col("c")).alias("t"), S.literal(F.col("d"), "array<int>").alias("x"), S.day_type(S.interval_label(F.col("a"))["day"]).alias("k")).collect()
    assert r[0].l.datetime.isoformat() == "2025-02-01T00:15:00" and r[0].l.day == "Sab" and r[0].k == "Weekend" and r[1].k == "Weekday"
    assert r[0].n == 12 and r[1].n is None and r[0].t.isoformat() == "2025-01-31T10:00:00" and r[0].x == [1, 2] and r[1].t is None


def test_full_outer_merge_matches_null_times(spark):
    mk = lambda c, rows: spark.createDataFrame(rows, f"datetime timestamp_ntz, {c} long")
    m = traffic.merge(mk("total_classi", [(None, 1)]), mk("total_lanes", [(None, 3)]), mk("transits", [(None, 1)])).collect()
    assert len(m) == 1 and m[0].classi_corsie == -2 and m[0].classi_transiti == 0


def test_bridge_boundaries(spark):
    s = spark.createDataFrame([(1, "A", 0.0), (2, "A", 10.0), (3, "A", 10.0), (4, "B", 12.0), (5, "B", 20.0)], "sensor_id long, span string, dist double")
    r = bridge.boundaries(s).collect()
    assert len(r) == 1 and (r[0].span_a, r[0].span_b, r[0].gap, r[0].tails, r[0].entries) == ("A", "B", 2.0, [2, 3], [4])
    assert [(x.a, x.b) for x in bridge.paired(s).collect()] == [(2, 3)]


def test_filter_and_spectrum_kernels():
    b, a = G.butter_bandpass(4, 0.2, 16.0, 100.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 100)) / np.polyval(a, np.exp(2j * np.pi * f / 100)))
    assert gain(2.0) == pytest.approx(1, abs=1e-3) and gain(0.2) == pytest.approx(math.sqrt(0.5), abs=1e-3) and gain(16.0) == pytest.approx(math.sqrt(0.5), abs=1e-3)
    t = np.arange(9000) / 100
    x = np.sin(2 * np.pi * 5 * t)
    y = G.filtfilt(b, a, x)
    assert np.abs(y - x)[3000:-3000].max() < 0.01
    assert np.allclose(G.lfilter(b, a, np.ones(50), G.settle(b, a)), 0, atol=1e-3)
    f, p = G.periodograms(x, 100.0, 512, 256)
    assert f[p.mean(0).argmax()] == pytest.approx(5, abs=0.2) and p.mean(0).sum() * f[1] == pytest.approx(0.5, rel=0.02)
    i = np.arange(500.0)
    assert np.allclose(G.cubic(i[::5], i[::5] ** 3, i), i**3) and np.allclose(G.cubic(i[::1], i**2, i + 0.5), (i + 0.5) ** 2)
    assert G.find_peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0]), 0.5, 1).tolist() == [1, 3, 6]


def test_tracker_finds_a_vehicle(spark):
    rows = [(p, p, 100 + p * 10 / 16.0, p * 10.0) for p in range(8)] + [(50, 3, 500.0, 30.0)]
    d = tracking.detections(spark.createDataFrame(rows, "event_id long, sensor_id long, t double, x double"))
    t = tracking.overlap_dedup(tracking.extend(tracking.seeds(d), d, 60.0))
    best = t.orderBy(F.desc(F.size("dids"))).first()
    assert best.dids == list(range(8)) and best.u == pytest.approx(16.0, abs=1e-6)
    p = {r.event_id: r.track for r in tracking.hard(tracking.jpda(t, d)).collect()}
    assert len({p[k] for k in range(8)}) == 1


@pytest.mark.parametrize("name", ["dual_score", "propagated_score"])
def test_scores_reach_every_likely_event(spark, name):
    """Each event that brute force gives a vehicle a score of 0.0005 at the first hop is a row, wherever the entry lies in its bin."""
    from tremor.plans import catalog

    sf = "/root/testdata/sf0.001"
    v, e = catalog._vehicles(spark, sf).toPandas(), catalog._sensor_events(spark, sf).toPandas()
    first = e.pos.min() if name == "propagated_score" else np.inf  # later hops of it start from an event
    e = e[e.pos <= first]
    d = e.pos.to_numpy() + 2300
    lo, hi = (v.entry.to_numpy()[:, None] + d / v[c].to_numpy()[:, None] for c in ("v_max", "v_min"))
    score = np.exp(-0.5 * ((e.t.to_numpy() - (lo + hi) / 2) / ((hi - lo) / 2)) ** 2)
    i, j = np.nonzero(score >= 0.0005)
    want = set(zip(v.vehicle.to_numpy()[i].tolist(), e.event.to_numpy()[j].tolist()))
    got = {(r.vehicle, r.event) for r in catalog.queries()[name](spark, sf).select("vehicle", "event").collect()}
    assert want and want <= got


def test_jpda_equals_enumeration(spark):
    tr = spark.createDataFrame([("a", 0.0, 10.0, [1]), ("b", 0.05, 10.0, [1])], "track string, a double, u double, dids array<long>")
    d = spark.createDataFrame([(1, 1, 1.02, 10.0)], "event_id long, sensor_id long, t double, x double")
    w = [math.exp(-0.5 * ((1.02 - m) / 0.05) ** 2) / (0.05 * math.sqrt(2 * math.pi)) for m in (1.0, 1.05)]
    z = 0.2 + w[0] + w[1] + w[0] * w[1]
    got = {r.track: r.p for r in tracking.jpda(tr, d).collect()}
    assert got == pytest.approx({"a": (w[0] + w[0] * w[1]) / z, "b": (w[1] + w[0] * w[1]) / z})


def test_dbscan_and_scale(spark):
    pts = [(i, 0.1 * (i % 5), 0.0) for i in range(5)] + [(10 + i, 5 + 0.1 * i, 5.0) for i in range(5)] + [(99, 50.0, 50.0)]
    d = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in pts], "id long, x double, y double")
    got = {r.id: r.cluster for r in cluster.dbscan(d, "id", ["x", "y"], 0.25, 3).collect()}
    assert got[99] == -1 and {got[i] for i in range(5)} == {0} and {got[10 + i] for i in range(5)} == {10}
    z = cluster.standard_scale(d.withColumn("c", F.lit(7.0)), ["x", "c"]).agg(F.avg("x"), F.stddev_pop("x"), F.max("c")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1) and z[2] == 0


def test_chains_follow_the_most_alike(spark):
    up, flat = [math.sin(k) for k in range(20)], [1.0] * 20
    # 20 m at 60 to 150 km/h take 0.48 to 1.2 s
    rows = [(0, 0.0, 1, 10.0, 1.0, up), (0, 0.0, 2, 50.0, 1.0, up), (1, 20.0, 3, 10.8, 1.0, flat), (1, 20.0, 4, 11.0, 1.0, up), (1, 20.0, 5, 10.1, 1.0, up), (1, 20.0, 6, 10.9, 9.0, up), (2, 40.0, 7, 11.9, 1.0, up)]
    d = spark.createDataFrame([("h", *r[:5], 1.0, r[5]) for r in rows], "hour string, place long, dist double, event long, t double, amp double, duration double, waveform array<double>")
    got = [(r.chain, r.place, r.event) for r in correlate.chains(d, "hour").orderBy("chain", "place").collect()]
    assert got == [(0, 0, 1), (0, 1, 4), (0, 2, 7)]
    assert correlate.chains(d.where("place = 0"), "hour").count() == 0


def test_samples_and_errors(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("time;030911FF_x;030911FF_y\n2025/03/01 10:00:00:010;1.5;\n2025/03/01 10:00:00:020;2.5;7\nbad;1;1\n")
    df = files.read_samples(spark, str(tmp_path / "x" / "a.csv"))
    with pytest.raises(ValueError, match="nope"):
        samples.sensors(df, "030911FF_x,nope")
    long = samples.to_long(df, samples.sensors(df))
    assert sorted((r.sensor, r.value) for r in long.collect()) == [("030911FF_x", 1.5), ("030911FF_x", 2.5), ("030911FF_y", 7.0)]
    with pytest.raises(ValueError):
        files.read_samples(spark, "x.bin")


def test_xlsx(spark, tmp_path):
    p = tmp_path / "t.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Data e ora</t></si><si><t>Car</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    r = files.read_xlsx(spark, str(p)).collect()
    assert len(r) == 1 and r[0]["Data e ora"] is None and r[0]["Car"] == "5"


def test_empty_table(spark):
    d = spark.createDataFrame([], "sensor string, i long, value double")
    assert events.triggers(d, ["sensor"], 1.0, 5, 1).count() == 0
    assert events.envelope_events(d, ["sensor"], 4, 2, 2).count() == 0
    assert stats.histogram(d, ["sensor"], "value", 5).count() == 0
