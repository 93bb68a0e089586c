"""The functions as SQL, and the interval sweep, against the DataFrame forms and plain scans."""

import random

import pytest
from pyspark.sql import functions as F
from strideframe.functions import activity as A
from strideframe.functions import surface
from strideframe.operators import bouts, reports, sleep, wear

from .test_detectors import _epochs, scan_80, scan_drops, scan_periods


@pytest.fixture(scope="module")
def known(spark):
    return surface.register(spark)


def test_scalars_give_what_the_columns_give(spark, known):
    rng = random.Random(1)
    rows = [(float(rng.choice([0, 100, 100.5, 101, 1951, 1952, 2453, 5724.5, 9499, -3, rng.randint(0, 12000)])), rng.random() * 9000, rng.choice([70.0, 0.0, 55.5, None]), 12.0, 15.0) for _ in range(200)] + [(None, None, None, None, 60.0)]
    df = spark.createDataFrame(rows, "cpm double, vm double, mass double, age double, epoch_seconds double")
    df.createOrReplaceTempView("minutes")
    got = spark.sql(f"SELECT freedson_level(cpm) AS f, broad_level(cpm) AS b, mets_level(cpm / 1000) AS m, {', '.join(f'mets_{n}(cpm, vm, mass, age) AS m_{n}' for n in A.METS)}, {', '.join(f'kcal_{n}(cpm, vm, mass, epoch_seconds) AS k_{n}' for n in A.ENERGY)}, vector_magnitude(cpm, vm, age) AS v, enmo(cpm, vm, age) AS e, counts_a_minute(cpm, epoch_seconds) AS c FROM minutes")
    c = F.col
    scale = 60.0 / c("epoch_seconds")
    want = df.select(
        A.freedson(c("cpm")), A.broad(c("cpm")), A.classify_mets(c("cpm") / 1000), *[A.mets(n, c("cpm"), c("vm"), c("mass"), c("age")) for n in A.METS],
        *[A.ENERGY[n](c("cpm") * scale, c("vm"), c("vm") * scale, c("mass"), scale) for n in A.ENERGY], A.vector_magnitude(c("cpm"), c("vm"), c("age")), A.enmo(c("cpm"), c("vm"), c("age")), c("cpm") * 60.0 / c("epoch_seconds"),
    )
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert set(known) == {*surface.SCALARS, *surface.TABLES}


def test_table_functions_give_what_the_operators_give(spark, known):
    rng = random.Random(2)
    series = [[rng.choices(["moderate", "light", None], [6, 2, 0.5])[0] for _ in range(rng.randint(1, 90))] for _ in range(20)]
    df = _epochs(spark, series, "intensity", "string").withColumn("wear_time", F.lit(True))
    df.withColumn("flag", F.col("intensity") == "moderate").createOrReplaceTempView("series")
    over = "TABLE(SELECT subject, epoch, timestamp, flag FROM series) PARTITION BY subject ORDER BY (epoch)"
    own = lambda rows, k: sorted((r.start_index, r.end_index) for r in rows if r.subject == f"s{k:03d}")
    drops = spark.sql(f"SELECT * FROM active_bouts({over}, 6, 2)").collect()
    share = spark.sql(f"SELECT * FROM active_share_bouts({over}, 6)").collect()
    for k, s in enumerate(series):
        active = [x == "moderate" for x in s]
        assert own(share, k) == scan_80(active, 6) and own(drops, k) == scan_drops(active, 6, 2)
    keys = lambda rows: sorted((r.subject, r.start_index, r.end_index) for r in rows)
    operators = bouts.mvpa_bouts(df, 6, 2).collect()
    assert keys(operators) == keys(drops) and {(r.subject, r.start_index): r.mvpa_minutes for r in operators} == {(r.subject, r.start_index): r.active_epochs for r in drops}
    worn = wear.wear_periods(df.withColumn("wear_time", F.col("intensity") == "moderate"))
    found = spark.sql(f"SELECT * FROM activity_runs({over})")
    columns = ["subject", "start_index", "end_index", "start_time", "end_time", "n_epochs"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, worn.select(*columns).collect()))


def test_sleep_periods_as_a_table_function(spark, known):
    rng = random.Random(3)
    series = []
    for _ in range(20):
        s = []
        while len(s) < 150:
            s += [rng.choice("SW")] * rng.randint(1, 24)
        series.append(s)
    df = _epochs(spark, series, "sleep_wake", "string")
    df.createOrReplaceTempView("nights")
    found = spark.sql("SELECT * FROM sleep_period_bounds(TABLE(SELECT subject, epoch, sleep_wake FROM nights) PARTITION BY subject ORDER BY (epoch), 4, 6, 20, 90, 9)").collect()
    for k, s in enumerate(series):
        assert sorted((r.start_index, r.last_index) for r in found if r.subject == f"s{k:03d}") == scan_periods(s, 4, 6, 20, 90, 9)
    periods = sleep.sleep_periods(df.withColumn("axis1", F.lit(1.0)), bedtime=4, waking=6, least=20, most=90, least_sleep=9)
    assert sorted((r.subject, r.start_index, r.last_index) for r in periods.collect()) == sorted(tuple(r) for r in found)


def test_an_interval_sweep_against_all_pairs(spark):
    rng = random.Random(4)
    stamp = lambda m: None if m is None else f"2024-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00"
    epochs = [(s, i, rng.choice([None, *range(0, 900)]) if rng.random() < 0.1 else i * 3) for s in ("a", "b", "c", "d", None) for i in range(300)]
    spans = [("a", rng.randint(0, 900), rng.randint(0, 30)) for _ in range(25)] + [("b", 10, 0), ("b", 10, 50), ("b", 60, 3), ("c", None, None), (None, 1, 100)]
    intervals = [(s, m, None if m is None else m + d) for s, m, d in spans] + [("b", 500, None), ("d", 800, 700)]
    left = spark.createDataFrame([(s, i, stamp(m)) for s, i, m in epochs], "subject string, epoch long, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("_kept", F.lit(1))
    right = spark.createDataFrame([(s, stamp(a), stamp(b)) for s, a, b in intervals], "subject string, start_time string, stop_time string")
    right = right.select("subject", F.col("start_time").cast("timestamp"), F.col("stop_time").cast("timestamp"))
    found = reports.in_filters(left, right)
    assert found.columns == left.columns
    has = {s for s, _, _ in intervals}
    inside = lambda s, m: any(s == t and None not in (m, a, b) and a <= m <= b for t, a, b in intervals)
    assert sorted(((r.subject, r.epoch) for r in found.collect()), key=repr) == sorted(((s, i) for s, i, m in epochs if s not in has or inside(s, m)), key=repr)
    assert reports.in_filters(left, right.limit(0)).count() == len(epochs)


def test_many_intervals_of_one_subject(spark):
    n = 200_000
    ids = spark.range(n)
    epochs = ids.select(F.lit("a").alias("subject"), (F.col("id") + 1).alias("epoch"), F.timestamp_micros(F.col("id") * 60_000_000).alias("timestamp"))
    at = F.timestamp_micros(F.col("id") * 20 * 60_000_000)
    filters = spark.range(10_000).select(F.lit("a").alias("subject"), at.alias("start_time"), (at + F.expr("INTERVAL 9 MINUTES")).alias("stop_time"))
    found = reports.in_filters(epochs, filters)
    assert found.count() == n // 2 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
