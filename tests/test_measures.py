"""Exact values on small cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strideframe.functions import activity as A
from strideframe.operators import bouts, circadian, raw, reports, stats, wear
from strideframe.plans.analysis import analyze, analyze_sleep, enrich
from strideframe.sources import readers


def _values(spark, values, expr, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in rows.withColumn("o", expr(F.col("v"))).orderBy("i").collect()]


def test_cut_points_leave_gaps(spark):
    got = _values(spark, [0.0, 100.0, 100.5, 101.0, 1951.0, 1951.5, 1952.0, 5725.0, 9499.0, -1.0, None], A.freedson)
    assert got == ["sedentary", "sedentary", None, "light", "light", None, "moderate", "vigorous", "very_vigorous", None, None]
    assert _values(spark, [150.0, 150.5, 151.0, 2201.0, 6001.0, 10001.0], A.broad) == ["sedentary", None, "light", "moderate", "vigorous", "very_vigorous"]
    assert _values(spark, [1.49, 1.5, 3.0, 6.0, 9.0, None], A.classify_mets) == ["sedentary", "light", "moderate", "vigorous", "very_vigorous", None]


def test_scaling_and_mass(spark):
    assert _values(spark, [100.0], lambda v: A.to_cpm(v, 15)) == [400.0]
    with pytest.raises(ValueError):
        A.to_cpm(F.lit(1), 0)
    assert _values(spark, [80.0, 0.0, -3.0, None], A.body_mass) == [80.0, 70.0, 70.0, 70.0]


def test_mets_and_energy(spark):
    one = lambda e: _values(spark, [3000.0], lambda v: e(v))[0]
    assert one(lambda v: A.mets("hendelman_adult", v, v)) == pytest.approx(1.602 + 0.000638 * 3000)
    assert one(lambda v: A.mets("freedson_adult", v, v)) == pytest.approx((0.00094 * 3000 + 0.1346 * 70 - 7.37418) * 200 / 245)
    assert _values(spark, [None, -1e9], lambda v: A.mets("swartz", v, v)) == [0.0, 0.0]
    with pytest.raises(ValueError):
        A.mets("freedson_children", F.lit(1.0), F.lit(1.0))
    assert one(lambda v: A.energy("freedson_combination", v, v, F.lit(70.0))) == pytest.approx(0.00094 * 3000 + 0.1346 * 70 - 7.37418)
    assert _values(spark, [0.0], lambda v: A.energy("freedson", v, v, F.lit(70.0))) == [pytest.approx(1.225)]


def test_texts(spark):
    assert _values(spark, [0.0, 719.6, 725.0, 1439.0], A.clock_12h) == ["12:00 AM", "12:00 PM", "12:05 PM", "11:59 PM"]
    assert _values(spark, ["f", "Male", "", None, "x"], A.format_gender, "string") == ["Female", "Male", "Undefined", "Undefined", "Undefined"]
    assert _values(spark, [59.0, 3600.0, 90061.0], A.format_duration) == ["59s", "1h 0m 0s", "1d 1h 1m 1s"]
    around = spark.createDataFrame([(1430.0,), (10.0,)], "m double").agg(A.circular_minutes(F.col("m")).alias("m")).first().m
    assert min(around, 1440 - around) < 1e-6


def test_ticks(spark):
    ticks = (1704067200 + 62135596800) * 10_000_000
    assert str(spark.range(1).select(A.ticks_to_timestamp(F.lit(ticks)).cast("string").alias("t")).first().t) == "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def demo(spark):
    return readers.demo_epochs(spark, 2, 3).withColumn("date", F.to_date("timestamp")).cache()


def test_analysis_holds_together(spark, demo):
    result = analyze(demo)
    rich = result.epochs.cache()
    assert rich.count() == demo.count()
    for row in result.intensity.groupBy("subject").agg(F.sum("minutes").alias("m")).collect():
        worn = rich.where((F.col("subject") == row.subject) & F.col("wear_time")).count()
        unclassed = rich.where((F.col("subject") == row.subject) & F.col("wear_time") & F.col("intensity").isNull()).count()
        assert row.m + unclassed == worn
    for r in result.fragmentation.collect():
        assert r.gini is None or 0 <= r.gini < 1
    for r in circadian.stability_and_variability(rich, circadian.worn_counts(rich)).collect():
        assert 0 <= r.interdaily_stability <= 1
    for r in result.rhythm.summary.collect():
        assert 0 <= r.r_squared <= 1 and 0 <= r.peak_hour < 24
    periods = wear.wear_periods(rich).agg(F.sum("n_epochs")).first()[0]
    assert periods == rich.where("wear_time").count()
    marked, found, summary = analyze_sleep(demo)
    assert summary.count() == 2 and marked.count() == demo.count()


def test_cosinor_finds_a_cosine(spark, demo):
    hour = F.hour("timestamp") + F.minute("timestamp") / 60
    wave = demo.withColumn("axis1", 500 + 200 * F.cos((hour - 15) * (2 * math.pi / 24)))
    r = circadian.cosinor(wave, F.col("axis1")).first()
    assert (r.mesor, r.amplitude, r.peak_hour) == (pytest.approx(500), pytest.approx(200), pytest.approx(15))
    best = circadian.rest_activity(wave, F.col("axis1")).first()
    assert best.m10_start == "10:00"


def test_alpha_and_gini(spark):
    df = spark.createDataFrame([("a", float(x), i) for i, x in enumerate([1, 2, 4, 8])] + [("b", 3.0, 0)], "subject string, duration double, start_index long")
    got = {r.subject: r.gini for r in bouts.gini(df).collect()}
    assert got["b"] is None and got["a"] == pytest.approx((2 * (1 + 4 + 12 + 32) - 5 * 15) / 60)
    alpha = {r.subject: r.a for r in df.groupBy("subject").agg(bouts.alpha(F.col("duration")).alias("a")).collect()}
    assert alpha["b"] is None and alpha["a"] == pytest.approx(1 + 4 / math.log(64))


def test_agreement(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "x double, y double")
    r = stats.validation(df, "x", "y").first()
    assert (r.n, r.bias, r.mae) == (3, pytest.approx(0), pytest.approx(2 / 3))
    c = stats.confusion(df, F.col("x") > 1.5, F.col("y") > 1.5).first()
    assert (c.tp, c.tn, c.fp, c.fn, c.specificity) == (2, 0, 0, 1, None)
    q = stats.quality(spark.createDataFrame([(0.0, 1.0, 0.0), (None, 1.0, 0.0), (20.0, 0.0, 0.0)], "x double, y double, z double")).first()
    assert (q.n_samples, q.missing_x, q.outliers, q.percent_missing) == (3, 1, 1, pytest.approx(100 / 9))


def test_filters_of_raw_signals():
    b, a = raw.butterworth_band(4, 0.25 / 15, 2.5 / 15)
    h = lambda f: abs(np.polyval(b, np.exp(1j * f)) / np.polyval(a, np.exp(1j * f)))
    assert h(2 * np.pi * 1.0 / 30) == pytest.approx(1, abs=0.05) and h(2 * np.pi * 8 / 30) < 0.01 and h(2 * np.pi * 0.25 / 30) == pytest.approx(math.sqrt(0.5), rel=1e-3)
    b, a = raw.chebyshev_low(8, 0.05, 0.4)
    assert abs(np.polyval(b, 1) / np.polyval(a, 1)) == pytest.approx(10 ** (-0.05 / 20), rel=1e-6)
    x = np.random.default_rng(1).normal(size=500)
    y = np.zeros(500)
    for i in range(500):
        y[i] = sum(raw.COUNTS_B[k] * (x[i - k] if i >= k else x[0]) for k in range(8)) - sum(raw.COUNTS_A[k] * y[i - k] for k in range(1, min(8, i + 1)))
    steady = raw.steady_filter(raw.COUNTS_B, raw.COUNTS_A, x)
    assert np.allclose(steady[400:], y[400:], atol=1e-3)


def test_counts_and_steps(spark):
    t = np.arange(0, 120, 1 / 30)
    still, walk = np.full(len(t), 1.0), 1 + 0.5 * np.sin(2 * np.pi * 1.8 * t)
    assert raw.count_signal(still, 30).sum() == 0 and len(raw.count_signal(walk, 30)) == 2 and raw.count_signal(walk, 30).min() > 100
    assert raw.count_steps(still, 30) == 0
    assert raw.count_steps_by_period(walk, 30) == pytest.approx(216, abs=16)
    df = readers.synthetic(spark, hours=0.1, rate=30, bouts=1)
    assert raw.counts(df, 30).count() == 6
    assert raw.process(df, 30).columns[-1] == "intensity"


def test_stretches_give_what_the_whole_gives(spark, monkeypatch):
    monkeypatch.setattr(raw, "STRETCH", 20_000)
    rng = np.random.default_rng(4)
    for rate, n in ((30, 70_001), (60, 130_000)):
        t = np.arange(n) / rate
        y = 1 + 0.4 * np.sin(2 * np.pi * 1.7 * t) * (np.sin(t / 300) > 0) + 0.05 * rng.normal(size=n)
        x, z = 0.3 * np.sin(2 * np.pi * 0.9 * t), 0.1 * rng.normal(size=n)
        pdf = pd.DataFrame({"subject": "a", "sample": np.arange(1, n + 1), "x": x, "y": y, "z": z, "rate": float(rate)})
        df = spark.createDataFrame(pdf).repartition(5).cache()
        for given in (rate, None):
            found = raw.counts(df, given).orderBy("epoch").toPandas()
            assert found["epoch"].tolist() == list(range(1, len(raw.count_signal(y, rate)) + 1))
            for name, signal in (("axis1", y), ("axis2", x), ("axis3", z)):
                assert np.abs(found[name] - raw.count_signal(signal, rate)).max() <= 1  # a sum of floors
        assert abs(raw.steps(df, rate).first().steps - raw.count_steps(y, rate)) <= 1
        assert raw.steps(df, rate, True).first().steps == raw.count_steps_by_period(y, rate)


def test_calibration(spark):
    rng = np.random.default_rng(2)
    rows = []
    for w in range(120):
        v = rng.normal(size=3)
        v = v / np.linalg.norm(v) + [0.04, -0.03, 0.02]
        rows += [("a", w * 5 + k + 1, *map(float, v)) for k in range(5)]
    df = spark.createDataFrame(rows, "subject string, sample long, x double, y double, z double")
    r = raw.calibration(df, 5).first()
    assert r.success and r.error_after < r.error_before / 5 and r.offset_x == pytest.approx(0.04, abs=0.01)
    fixed = raw.apply_calibration(df, raw.calibration(df, 5))
    assert fixed.columns == df.columns and fixed.count() == df.count()
    assert not raw.calibration(df, 5, least=1000).first().success


def test_intervals_bind_only_subjects_that_have_some(spark):
    epochs = readers.demo_epochs(spark, 3, 1).cache()
    one = epochs.where("subject = 'demo0' and epoch = 481").select("subject", F.col("timestamp").alias("start_time"), (F.col("timestamp") + F.expr("INTERVAL 59 MINUTES")).alias("stop_time"))
    outside = one.select(F.lit("demo1").alias("subject"), (F.col("start_time") - F.expr("INTERVAL 9 DAYS")).alias("start_time"), (F.col("stop_time") - F.expr("INTERVAL 9 DAYS")).alias("stop_time"))
    filters = one.union(one).union(outside)
    kept = reports.in_filters(epochs, filters)
    assert kept.columns == epochs.columns and {r.subject: r["count"] for r in kept.groupBy("subject").count().collect()} == {"demo0": 60, "demo2": 1440}
    assert reports.in_filters(epochs, filters.limit(0)).count() == 3 * 1440
    rich = enrich(epochs).cache()
    valid = wear.valid_days(rich)
    plain, found = ({r.subject: r for r in reports.batch_report(rich, valid, filters=f).collect()} for f in (None, filters))
    assert {s: r.n_epochs for s, r in found.items()} == {"demo0": 60, "demo1": 0, "demo2": 1440}
    assert found["demo2"] == plain["demo2"] and found["demo0"].valid_days == plain["demo0"].valid_days
    assert found["demo0"].axis1_counts == epochs.where("subject = 'demo0' and epoch between 481 and 540").agg(F.sum("axis1")).first()[0]
    assert found["demo1"].axis1_counts == found["demo1"].sedentary_percent == found["demo1"].mvpa_per_day == 0
    assert {s: r.n_epochs for s, r in ((r.subject, r) for r in reports.batch_report(rich, valid, filters=filters.limit(0)).collect())} == {s: 1440 for s in plain}


def test_a_recording_is_processed_whole(spark):
    walk = "0.5 * sin(id * 2 * pi() * 1.8 / 30)"
    make = lambda name, n, moving: spark.range(n).select(F.lit(name).alias("subject"), (F.col("id") + 1).alias("sample"), F.lit(0.01).alias("x"), (1 + F.when(F.col("id") >= moving, F.expr(walk)).otherwise(0.0)).alias("y"), F.expr(walk).alias("z"))
    df = make("a", 70 * 1800, 65 * 1800).union(make("short", 900, 0)).cache()
    done = raw.processed(df, 30)
    epochs = done.epochs.where("subject = 'a'").orderBy("epoch").collect()
    assert [r.wear_time for r in epochs[:60]] == [False] * 60 and epochs[-1].wear_time
    assert all(r.intensity == "sedentary" and r.vm > 1952 for r in epochs[:60])  # z moves, the vertical doesn't
    totals = {r.subject: r for r in done.totals.collect()}
    a, worn = totals["a"], [r for r in epochs if r.wear_time]
    assert (a.total_wear_minutes, a.mvpa_minutes) == (len(worn), sum(r.intensity in A.MVPA for r in worn)) and a.mvpa_minutes >= 4
    assert a.total_counts_y == sum(r.axis1 for r in worn) and a.total_counts_vm == pytest.approx(sum(r.vm for r in worn))
    assert {r.intensity: r.minutes for r in done.intensity.collect()} == {x: sum(r.intensity == x for r in worn) for x in A.LEVELS}
    y = np.array([r.y for r in df.where("subject = 'a'").orderBy("sample").collect()])
    assert a.total_steps == raw.count_steps(y, 30) and totals["short"].total_wear_minutes == totals["short"].total_counts_y == 0
    other = raw.processed(df.where("subject = 'short'"), 30, 5, A.broad, "long_window", True, "autocorr", True).totals.first()
    assert other.total_steps == raw.count_steps_by_period(1 + 0.5 * np.sin(np.arange(900) * 2 * np.pi * 1.8 / 30), 30) and other.total_wear_minutes == 0.5
    for wrong in ({"wear_algorithm": "none"}, {"step_method": "none"}):
        with pytest.raises(ValueError):
            raw.processed(df, 30, **wrong)
    assert raw.processed(df, 30, calculate_steps=False).totals.first().total_steps is None
