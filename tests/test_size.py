"""Queries that took one Python call for each vehicle, track or group: sf0.01 within half of what that took."""

import time

import pytest

from tremor.plans import catalog

SLOW = [
    "propagated_score",
    "propagated_unified",
    "dual_score",
    "tracker_temporal",
    "track_extend",
    "track_lines",
    "track_steps",
    "track_dedup",
    "jpda",
]


@pytest.mark.parametrize("name", SLOW)
def test_sequential_work_is_done_in_blocks(spark, name):
    spark.range(1000).count()
    began = time.time()
    catalog.queries()[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    assert time.time() - began < 35


def test_blocks_of_pairs_do_not_change_scores(spark, monkeypatch):
    from tremor.operators import tracking

    sf = "/root/testdata/sf0.001"
    v, e = catalog._vehicles(spark, sf).where("vehicle < 200"), catalog._sensor_events(spark, sf)
    for f in (tracking.propagated, tracking.dual_score, tracking.temporal_tracker):
        want = sorted(map(repr, f(v, e).collect()))
        with monkeypatch.context() as m:
            m.setattr(tracking, "PAIRS", 100)  # less than one vehicle has
            assert sorted(map(repr, f(v, e).collect())) == want


def test_tiny_scores_round_to_zero(spark):
    d = spark.createDataFrame([(x,) for x in (5e-7, 4.9e-7, -4e-7, 1e-300, -0.0, 0.1234565, None)], "x double")
    assert [repr(r.x) for r in catalog.out(d, 6).collect()] == ["1e-06", "0.0", "0.0", "0.0", "0.0", "0.123457", "None"]


def test_unified_scores_take_the_best_from_the_kernel(spark):
    from tremor.operators import reports, tracking

    sf = "/root/testdata/sf0.001"
    v, e = catalog._vehicles(spark, sf).where("vehicle < 200"), catalog._sensor_events(spark, sf)
    quick, plain = reports.unified(tracking.propagated(v, e, best=True)), reports.unified(tracking.propagated(v, e))
    assert quick.columns == plain.columns and sorted(map(repr, quick.collect())) == sorted(map(repr, plain.collect()))
    assert "Window" not in quick._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_that_of_numpy():
    import random

    import numpy as np

    from tremor.operators import tracking

    rng = random.Random(5)
    for n in range(2, 12):
        x, t = [rng.random() * 70 for _ in range(n)], [rng.random() * 1e6 for _ in range(n)]
        i, j = np.array(x), np.array(t)
        b = ((i - i.mean()) * (j - j.mean())).sum() / ((i - i.mean()) ** 2).sum()
        assert tracking._line(x, t) == ((j.mean() - b * i.mean(), 1 / b) if b > 0 else None)
    assert tracking._line([1.0], [2.0]) is None and tracking._line([3.0, 3.0], [1.0, 2.0]) is None


def test_overlap_dedup_equals_comparing_all_kept(spark):
    import random

    from tremor.operators import tracking

    rng = random.Random(7)
    rows = [(f"t{k}", rng.choice([0.0, 1.0, 2.0]), sorted(rng.sample(range(120 * (k % 3), 120 * (k % 3) + 60), rng.randint(1, 6)))) for k in range(150)]
    kept, want = [], set()
    for name, _, dids in sorted(rows, key=lambda r: (-len(r[2]), -r[1], r[0])):
        own = set(dids)
        if all(len(own & k) / min(len(own), len(k)) <= 0.3 for k in kept):
            kept.append(own)
            want.add(name)
    got = tracking.overlap_dedup(spark.createDataFrame(rows, "track string, score double, dids array<long>"))
    assert {r.track for r in got.collect()} == want and len(want) < 150
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tracks_link_across_batches(spark):
    import random

    from tremor.operators import tracking

    rng = random.Random(3)
    rows = [(f"t{k}", rng.sample(range(100 * (k % 4), 100 * (k % 4) + 70), rng.randint(0, 3)) or None) for k in range(120)]
    group = {name: {name} for name, _ in rows}
    for a, x in rows:
        for b, y in rows:
            if set(x or ()) & set(y or ()) and group[a] is not group[b]:
                group[a] |= group[b]
                group.update(dict.fromkeys(group[a], group[a]))
    t = spark.createDataFrame(rows, "track string, dids array<long>")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for parts, batch in ((1, most), (5, 7), (3, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.track: r.component for r in tracking.shared(t.repartition(parts)).select("track", "component").collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        assert got == {name: min(g) for name, g in group.items()}


def test_few_links_of_tracks_need_rounds(spark, monkeypatch):
    from tremor.operators import graph, tracking

    sf, links, plain = "/root/testdata/sf0.01", [], graph.components
    monkeypatch.setattr(graph, "components", lambda e, **k: links.append(e.count()) or plain(e, **k))
    d = graph.saved(catalog._detections(spark, sf))
    tracks = graph.saved(tracking.extend(tracking.seeds(d), d, 30.0))
    tracking.overlap_dedup(tracks).count()
    assert links and sum(links) < tracks.count() / 10


def test_tracks_followed_together_equal_those_followed_alone(spark, monkeypatch):
    import random

    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from tremor.operators import tracking

    rng, calls, line, together = random.Random(11), [], tracking._line, tracking._follow_short
    monkeypatch.setattr(tracking, "_line", lambda *a: calls.append(1) or line(*a))
    sparse = [(k, 0, float(k), rng.randrange(8) * 10.0) for k in range(3000)]
    dense = [(k, 0, 3100 + rng.random() * 60, rng.randrange(8) * 10.0) for k in range(5000, 5250)]
    kinds = {True: [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()], False: [pa.string(), *[pa.float64()] * 3, pa.list_(pa.int64())]}
    for rows, short in ((sparse, True), (sparse + dense, False)):
        d = tracking.detections(spark.createDataFrame(rows, "event_id long, sensor_id long, t double, x double"))
        for steps in (True, False):
            made = []
            with monkeypatch.context() as m:
                m.setattr(PandasGroupedOpsMixin, "applyInArrow", lambda self, f, schema: made.append((f, self._df)))
                tracking.extend(tracking.seeds(d), d, 30.0, steps)
            (f, both), = made
            both = both.toArrow()
            groups = [both.filter(pc.equal(both["_b"], b)).combine_chunks().to_batches() for b in pc.unique(both["_b"])]
            run = lambda: sorted(repr(r) for g in groups for b in f(iter(g)) for r in b.to_pylist())  # noqa: B023, E731
            calls.clear()
            got, scalar = run(), len(calls)
            with monkeypatch.context() as m:
                m.setattr(tracking, "_follow_short", lambda *_: ([pa.nulls(0, k) for k in kinds[steps]], together(*_)[1] | True))  # noqa: B023
                calls.clear()
                assert run() == got and len(got) > 1000
            assert scalar == 0 if short else 0 < scalar < len(calls)
