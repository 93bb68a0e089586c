"""Window forms of the sequential detectors against plain scans of random series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strideframe.operators import bouts, islands, sleep, wear

SERIES = 24


def scan_wear(c, rule):
    """A straight search from the left, one start after another."""
    n, worn, i = len(c), [True] * len(c), 0
    while i + rule.window <= n:
        win = c[i : i + rule.window]
        spikes = [k for k in range(i, i + rule.window) if 0 < c[k] <= rule.stop]
        longest = run = 0
        for v in win:
            run = run + 1 if 0 < v <= rule.stop else 0
            longest = max(longest, run)
        ok = sum(v == 0 for v in win) >= rule.window - rule.tolerance and longest <= rule.tolerance
        if rule.neighbours is None:
            ok = ok and max(win) <= rule.stop
        else:
            for k in spikes:
                up, down = c[max(0, k - rule.neighbours) : k], c[k + 1 : k + 1 + rule.neighbours]
                ok = ok and ((up and not any(up)) or (down and not any(down)))
        if not ok:
            i += 1
            continue
        for k in range(i, i + rule.window):
            worn[k] = False
        p = i + rule.window
        while p < n and c[p] <= rule.stop:
            q = p
            while q < n and 0 < c[q] <= rule.stop:
                q += 1
            if q - p > rule.tolerance:
                p = q
                break
            for k in range(p, max(q, p + 1)):
                worn[k] = False
            p = max(q, p + 1)
        i = p
    return worn


def scan_80(active, least):
    out, i, n = [], 0, len(active)
    while i + least <= n:
        if sum(active[i : i + least]) >= math.ceil(0.8 * least):
            j = i + least
            while j < n and sum(active[i : j + 1]) >= math.ceil(round(0.8 * (j + 1 - i), 9)):
                j += 1
            out.append((i + 1, j))
            i = j
        else:
            i += 1
    return out


def scan_drops(active, least, allowed):
    out, i, n = [], 0, len(active)
    while i < n:
        if not active[i]:
            i += 1
            continue
        last = j = i
        while j < n and j - last <= allowed + active[j]:
            last = j if active[j] else last
            j += 1
        end = n - 1 if j == n else last
        if end - i + 1 >= least:
            out.append((i + 1, end + 1))
        i = j
    return out


def scan_webster(s):
    """Five rules, each reading the first states."""
    n, out = len(s), list(s)

    def before(i):
        k = 0
        while i - 1 - k >= 0 and s[i - 1 - k] == "W":
            k += 1
        return k

    def after(i):
        k = 0
        while i + k < n and s[i + k] == "W":
            k += 1
        return k

    for i in range(1, n):
        for wake, m in ((4, 1), (10, 3), (15, 4)):
            if s[i : i + m] == ["S"] * m and before(i) >= wake:
                out[i : i + m] = ["W"] * m
    i = 0
    while i < n:
        if s[i] == "S":
            j = i
            while j < n and s[j] == "S":
                j += 1
            for most, wake in ((6, 15), (10, 20)):
                if j - i <= most and before(i) >= wake and after(j) >= wake:
                    out[i:j] = ["W"] * (j - i)
            i = j
        else:
            i += 1
    return out


def scan_periods(s, bedtime, waking, least, most, least_sleep):
    n, i, out = len(s), 0, []
    while i + bedtime <= n:
        if all(x == "S" for x in s[i : i + bedtime]):
            wake = next((j for j in range(i + bedtime, n - waking + 1) if all(x == "W" for x in s[j : j + waking])), None)
            if wake is not None and least <= wake - i < most and s[i:wake].count("S") >= least_sleep:
                out.append((i + 1, wake))
                i = wake
                continue
        i += 1
    return out


def _epochs(spark, series, column="axis1", kind="double"):
    rows = [(f"s{k:03d}", i, v) for k, s in enumerate(series) for i, v in enumerate(s, 1)]
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("epoch") * 60000000)
    return spark.createDataFrame(rows, f"subject string, epoch long, {column} {kind}").withColumn("timestamp", ts).withColumn("date", F.to_date("timestamp"))


@pytest.mark.parametrize("rule", [wear.WearRule(8, 2, 100), wear.WearRule(10, 3, 100, 4), wear.WearRule(6, 1, 50, 2)])
def test_wear(spark, rule):
    rng = random.Random(1)
    series = [[rng.choices([0.0, 20.0, 100.0, 500.0], [10, 2, 0.5, rng.choice([0.2, 1])])[0] for _ in range(rng.randint(1, 120))] for _ in range(SERIES)]
    found = wear.wear(_epochs(spark, series), rule).orderBy("subject", "epoch").collect()
    for k, s in enumerate(series):
        assert [r.wear_time for r in found if r.subject == f"s{k:03d}"] == scan_wear(s, rule), s


def test_wear_takes_nulls_as_zeros(spark):
    df = _epochs(spark, [[None] * 12 + [500.0] * 3])
    assert [r.wear_time for r in wear.wear(df, wear.WearRule(10, 2, 100)).orderBy("epoch").collect()] == [False] * 12 + [True] * 3


def test_bouts(spark):
    rng = random.Random(2)
    series = [[rng.choices(["moderate", "light", None], [6, 2, 0.5])[0] for _ in range(rng.randint(1, 90))] for _ in range(SERIES)]
    df = _epochs(spark, series, "intensity", "string").withColumn("wear_time", F.lit(True))
    drops, share = bouts.mvpa_bouts(df, 6, 2).collect(), bouts.mvpa_bouts_80(df, 6).collect()
    for k, s in enumerate(series):
        active = [x == "moderate" for x in s]
        own = lambda rows: sorted((r.start_index, r.end_index) for r in rows if r.subject == f"s{k:03d}")  # noqa: B023, E731
        assert own(share) == scan_80(active, 6)
        assert own(drops) == scan_drops(active, 6, 2), s
    for r in drops:
        assert r.mvpa_minutes == series[int(r.subject[1:])][r.start_index - 1 : r.end_index].count("moderate")


def test_webster_and_periods(spark):
    rng = random.Random(3)
    series = []
    for _ in range(SERIES):
        s = []
        while len(s) < 150:
            s += [rng.choice("SW")] * rng.randint(1, 24)
        series.append(s)
    df = _epochs(spark, series, "sleep_wake", "string").withColumn("axis1", F.lit(1.0))
    found = sleep.webster(df).orderBy("subject", "epoch").collect()
    periods = sleep.sleep_periods(df, bedtime=4, waking=6, least=20, most=90, least_sleep=9).collect()
    for k, s in enumerate(series):
        name = f"s{k:03d}"
        assert [r.sleep_wake for r in found if r.subject == name] == scan_webster(s), s
        assert sorted((r.start_index, r.last_index) for r in periods if r.subject == name) == scan_periods(s, 4, 6, 20, 90, 9)
    for r in periods:
        own = series[int(r.subject[1:])][r.start_index - 1 : r.last_index]
        assert (r.sleep_time, r.wake_time, r.total_counts) == (own.count("S"), own.count("W"), len(own))
        assert r.number_of_awakenings == "".join(own).replace("S", " ").split().__len__()


def test_a_long_series_takes_time_in_proportion(spark):
    n = 500_000
    ids = spark.range(n).select(F.lit("a").alias("subject"), (F.col("id") + 1).alias("epoch"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 60000000).alias("timestamp"))
    still = F.floor((F.col("epoch") - 1) / 600) % 2 == 0
    df = ids.withColumn("axis1", F.when(still, 0.0).otherwise(1000.0))
    worn = wear.wear(df, wear.TROIANO)
    assert worn.where("wear_time").count() == n // 1200 * 600 + max(0, n % 1200 - 600)
    marked = df.withColumn("sleep_wake", F.when(still, F.lit("S")).otherwise(F.lit("W")))
    periods = sleep.sleep_periods(marked)
    assert periods.count() == -(-n // 1200) and {r.sleep_time for r in periods.select("sleep_time").distinct().collect()} == {600.0}


def test_stretches_give_what_a_whole_series_gives(spark, monkeypatch):
    """Series cut into many stretches that reach over into their neighbours."""
    rng = random.Random(6)
    series, states = [], []
    for _ in range(6):
        s, c = [], []
        while len(s) < 900:
            k = rng.randint(1, 24)
            s += [rng.choice("SW")] * k
            c += [rng.choice([0.0, 0.0, 40.0, 900.0])] * k
        states.append(s[: rng.choice([1, 2, 700, 900])])
        series.append(c[: rng.choice([1, 65, 897])])
    counts, sleeping = _epochs(spark, series).cache(), _epochs(spark, states, "sleep_wake", "string").withColumn("axis1", F.lit(1.0)).cache()
    marks = lambda: [sorted(map(tuple, d.select("subject", "epoch", "sleep_wake").collect())) for d in (sleep.cole_kripke(counts), sleep.cole_kripke(counts, rescore=True), sleep.sadeh(counts), sleep.webster(sleeping))]
    options = {"bedtime": 2, "waking": 3, "least": 4, "most": 30, "least_sleep": 3}
    found = lambda: sorted(map(str, sleep.sleep_periods(sleeping, **options).collect()))
    wakes = lambda: sorted(map(str, sleep.inner_wakes(sleeping, sleep.sleep_periods(sleeping, **options), 1).collect()))
    quiet = lambda: sorted(map(str, wear.wear_periods(counts.withColumn("wear_time", F.col("axis1") < 100)).collect()))
    whole = marks(), found(), wakes(), quiet()
    monkeypatch.setattr(islands, "STRETCH", 16)
    assert islands.overlapped(counts, 4, 2).select("_stretch").distinct().count() > 20
    cut = marks(), found(), wakes(), quiet()
    assert cut == whole
    for k, s in enumerate(states):
        name = f"s{k:03d}"
        assert [m for subject, _, m in cut[0][3] if subject == name] == scan_webster(s)
    assert sum(len(scan_periods(s, 2, 3, 4, 30, 3)) for s in states) == len(cut[1]) > 20


def test_one_long_series_is_many_tasks(spark):
    """The measures of one subject's sleep take its series in stretches, none of which holds more than its share."""
    n = 3_000_000
    ids = spark.range(n).select(F.lit("a").alias("subject"), (F.col("id") + 1).alias("epoch"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 1000000).alias("timestamp"))
    df = ids.withColumn("axis1", F.when(F.floor((F.col("epoch") - 1) / 600) % 2 == 0, 0.0).otherwise(5000.0))
    stretches = islands.overlapped(df, 64, 64).groupBy("_stretch").count().collect()
    assert len(stretches) > 20 and max(r["count"] for r in stretches) <= islands.STRETCH + 128
    marked = sleep.cole_kripke(df, rescore=True)
    periods = sleep.sleep_periods(marked, epoch_seconds=1)
    assert periods.count() == n // 1200 and periods.where("wake_time > 0.2").count() == 0


def test_stretches_leave_their_subjects_task(spark, monkeypatch):
    """Also after windows by subject, which number the epochs, the stretches of one series are dealt out to many tasks."""
    monkeypatch.setattr(islands, "STRETCH", 1000)
    n, before = 60_000, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("16", "false")):
            spark.conf.set(k, v)
        df = spark.range(1, n + 1).select(F.lit("a").alias("subject"), F.col("id").alias("epoch"), (F.col("id") % 700).cast("double").alias("axis1"))
        df = df.withColumn("epoch", F.row_number().over(islands.series()).cast("long"))
        for found in (sleep.cole_kripke(df), sleep.cole_kripke(df, rescore=True), sleep.sadeh(df), islands.overlapped(df, 1, 200)):
            tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
            assert len(tasks) > 8 and max(tasks) < n / 3, tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bouts_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(islands, "STRETCH", 7)
    rng = random.Random(12)
    series = [[rng.choices(["moderate", "light", None], rng.choice([[6, 2, 0.5], [1, 5, 0], [9, 1, 0]]))[0] for _ in range(rng.randint(1, 120))] for _ in range(30)] + [["light"] * 20, ["moderate"] * 15 + ["light"] * 2]
    df = _epochs(spark, series, "intensity", "string").withColumn("wear_time", F.lit(True))
    drops, sitting = bouts.mvpa_bouts(df, 6, 2).collect(), wear.wear_periods(df.withColumn("wear_time", F.col("intensity") == "light")).collect()
    for k, s in enumerate(series):
        assert sorted((r.start_index, r.end_index) for r in drops if r.subject == f"s{k:03d}") == scan_drops([x == "moderate" for x in s], 6, 2), s
        assert sum(r.n_epochs for r in sitting if r.subject == f"s{k:03d}") == s.count("light")
    for r in drops:
        assert r.mvpa_minutes == series[int(r.subject[1:])][r.start_index - 1 : r.end_index].count("moderate")


def test_share_bouts_against_a_scan():
    rng = random.Random(13)
    for _ in range(3000):
        active = [rng.random() < rng.choice([0.2, 0.75, 0.85, 0.95]) for _ in range(rng.randint(0, 200))]
        least = rng.randint(1, 12)
        assert [(a, b) for a, b, _ in bouts.share_bouts(np.array(active, int), least)] == scan_80(active, least)
        assert all(n == sum(active[a - 1 : b]) for a, b, n in bouts.share_bouts(np.array(active, int), least))
