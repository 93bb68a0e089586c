import hashlib
import math

import numpy as np
from pyspark.sql import functions as F
from strideframe.llm import heap_lloyd

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, entries=256, rounds=4, scale=1024, parts=4):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    x = np.array([v + [0] * (parts * width - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, width)
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][1]))[:entries]
    books = [x[first, p].copy() for p in range(parts)]
    for again in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        near = [e.argmin(axis=1) for e in d]
        if again == rounds:
            break
        for p in range(parts):
            for e in set(near[p].tolist()):
                own = x[near[p] == e, p]
                books[p][e] = own.sum(axis=0) // len(own)
    error = sum(e.min(axis=1) for e in d)
    labels = {}
    for (_, _, k), e in zip(kept, error.tolist()):
        labels[k] = labels.get(k, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{near[p][n]:02x}" for p in range(parts)), int(error[n]), labels[k], sha) for n, (i, _, k) in enumerate(kept)), key=repr)


def compressed(spark, rows, partitions=3, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("own")).withColumn("ID", F.lit("own")).repartition(partitions)
    return sorted((tuple(r) for r in heap_lloyd.compress(df, **options).collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(int(i), [float(x) for x in centres[rng.integers(40)] + 0.3 * rng.normal(size=16)], int(rng.integers(5)) if i % 7 else None) for i in rng.permutation(3000)]
    assert compressed(spark, rows) == brute_force(rows)
    monkeypatch.setattr(heap_lloyd, "BLOCK", 100)
    assert compressed(spark, rows, entries=24, rounds=6) == brute_force(rows, entries=24, rounds=6)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    few = [[float(x) for x in rng.integers(-2, 3, 8) / 2] for _ in range(30)]
    rows = [(i, few[0] if i % 3 == 0 else few[int(rng.integers(30))], i % 3) for i in range(600)]
    rows += [rows[4], rows[4], (None, few[3], 1), (None, few[3], None), (700, None, 0), (701, [None] * 8, 0), (702, [float("nan")] * 8, 0), (703, [float("-inf")] * 8, 0), (704, few[1][:5], 9), (705, [], 9)]
    assert compressed(spark, rows, entries=20) == brute_force(rows, entries=20)


def test_few_rows_large_components_and_no_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [4.0, 5.0, 6.0], 0), (2, [4.0, 5.0, 6.0], 1)]
    assert compressed(spark, rows) == brute_force(rows)
    assert len(compressed(spark, [*rows, (9, [3e38, -3e38], 1)])) == 4
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 0)]) == []


def test_rounds_leave_parts_alone_whose_bounds_hold(spark):
    """Exact, though most parts of well parted groups aren't looked at again."""
    rng = np.random.default_rng(6)
    centres = 20 * rng.normal(size=(16, 8))
    rows = [(i, [float(x) for x in centres[i % 16] + 0.05 * rng.normal(size=8)], 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    state, books, _ = heap_lloyd.train(df, entries=16)
    assert state.agg(F.sum("rescanned")).first()[0] < 800
    assert compressed(spark, rows, entries=16) == brute_force(rows, entries=16)


def test_advance_equals_a_full_scan():
    rng = np.random.default_rng(7)
    parts, entries = rng.integers(-400, 400, (900, 6)), rng.integers(-400, 400, (30, 6))
    books = heap_lloyd.Codebooks([entries])
    heaps = heap_lloyd.Heaps.of(parts, entries, books.drift[0])
    for _ in range(12):
        sums = {(0, e): (int((heaps.near == e).sum()), parts[heaps.near == e].sum(axis=0).tolist()) for e in np.unique(heaps.near).tolist()}
        books = books.moved(sums)
        heaps.advance(parts, books.entries[0], books.drift[0])
        heaps = heap_lloyd.Heaps.unpacked(len(parts), *heaps.packed())
        assert (heaps.near == ((parts[:, None] - books.entries[0][None]) ** 2).sum(axis=2).argmin(axis=1)).all()
