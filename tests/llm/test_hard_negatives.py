import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from strideframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, positives=5, negatives=3):
    own = []
    for i, v, k in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((i, [math.floor(256 * float(np.float32(x))) for x in v], k))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, (i, v, k) in enumerate(own):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for at, (j, w, m) in enumerate(own) if at != n]
        same = sorted((s for s in scored if s[2] == k), key=order)[:positives]
        other = sorted((s for s in scored if s[2] != k), key=order)
        for score, j, _ in same:
            hard = [s for s in other if 50 * score <= 100 * s[0] <= 95 * score][:negatives]
            out += [(i, j, r, s[1], score, s[0]) for r, s in enumerate(hard, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("own")).withColumn("v", F.lit("own"))
    found = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(rng, n, dim, spread):
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    v = (rng.normal(size=(n, dim)) * spread ** np.arange(dim)) @ axes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "dim", "spread", "tile"), [(600, 16, 0.7, 65_536), (500, 16, 1.0, 90), (900, 5, 0.9, 200)])
def test_against_brute_force(spark, monkeypatch, n, dim, spread, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "FIRST_LOT", 16)
    rng = np.random.default_rng(n)
    v = vectors(rng, n, dim, spread)
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]
    assert mined(spark, rows) == brute_force(rows)


def test_copies_ties_and_odd_rows(spark):
    rng = random.Random(3)
    few = [[rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)] for _ in range(12)]
    rows = [(i, few[i % 12] if i % 3 else few[0], i % 2 if i % 5 else 0) for i in range(400)]
    rows += [rows[50], rows[50], rows[7], (None, few[1], 0), (None, few[0], 1), (None, few[0], 1)]
    rows += [(900, None, 1), (950, few[2], None), (1000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1050, [float("nan")] * 6, 0), (1100, [float("inf")] * 6, 1), (1150, [0.0] * 6, 0), (1200, few[5], 77)]
    rng.shuffle(rows)
    assert mined(spark, rows) == brute_force(rows)


def test_large_components_and_short_vectors(spark):
    rows = [(0, [3e38, -3e38], 0), (1, [3e38, 1.0], 0), (2, [3e38, 2.0], 1), (3, [1.0], 1), (50, [], 0)]
    found = mined(spark, rows)
    assert all(abs(r[4]) < 1 << hard_negatives.SCORE_BITS for r in found)
    assert [r[:4] for r in found if r[1] == 50 or r[0] == 50] == [(50, 0, 1, 2), (50, 0, 2, 3), (50, 1, 1, 2), (50, 1, 2, 3)] + [(0, 50, 1, 3)] * 0


def test_discards_early(spark):
    """With energy in the first components most pairs are discarded after them."""
    rng = np.random.default_rng(1)
    whole = np.floor(256 * vectors(rng, 3000, 32, 0.6)).astype(np.int64)
    axes, ends = hard_negatives.rotation(whole.astype(float))
    assert np.allclose(axes.T @ axes, np.eye(32)) and len(ends) > 1 and ends[0] < 6
    turned = hard_negatives.Rotated(whole, axes, ends)
    seen, i, j = [], np.arange(40), np.arange(3000)
    floor = np.sort(whole[i] @ whole.T, axis=1)[:, -6].astype(float)

    def wanted(partial, bound, at):
        keep = partial + bound >= (floor[:, None] if at is None else floor[at[0]])
        seen.append(int(np.count_nonzero(keep)))
        return keep

    p, q, scores = hard_negatives._survivors(turned, i, turned, j, wanted)
    assert (scores == (whole[i] @ whole.T)[p, q]).all()
    assert seen[0] < 40 * 3000 / 8 and len(p) < 1000
    for n in i:
        assert set(np.flatnonzero(whole[n] @ whole.T >= floor[n])) <= set(q[p == n].tolist())


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
