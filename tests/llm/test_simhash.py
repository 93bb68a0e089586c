import random

import numpy as np
import xxhash
from pyspark.sql import functions as F
from strideframe.llm import simhash


def fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def least_reachable(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_brute_force(documents):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 300))) for _ in range(40)]
    rows = []
    for i in range(260):
        words = rng.choice(base).split(" ")
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((1000 - i, " ".join(words).upper() if i % 9 == 0 else "\n".join(words)))
    rows += [(2000, None), (3, ""), (4, "  ")]
    found = {r.doc_id: r for r in simhash.near_duplicates(documents(rows)).collect()}
    prints = {i: fingerprint(t or "") for i, t in rows}
    assert {i: r.simhash % (1 << 64) for i, r in found.items()} == prints
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in found.items()} == least_reachable(pairs, prints)
    kept = simhash.drop_near_duplicates(documents(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(r.component_id for r in found.values()))


def test_links_within_four_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 30)
    values = set(base.tolist()) | {0, -1, 1 << 62}
    for v in base.tolist():
        for _ in range(12):
            flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
            values.add(int(np.int64(np.uint64(v & (1 << 64) - 1) ^ np.uint64(sum(1 << int(f) for f in flips)))))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "simhash long")
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for groups, distance, crowd in ((8, 4, 64), (8, 4, 15), (10, 4, 64), (12, 4, 64), (8, 2, 64), (8, 0, 64)):
        where, members = simhash.places(df, distance, crowd, groups)
        assert members.isEmpty()
        assert {tuple(r) for r in simhash.links(where, members, distance).collect()} == {(a, b) for a in values for b in values if a < b and bits(a, b) <= distance}


def test_chance_neighbours_arent_enumerated(spark):
    """A million random fingerprints: none is taken for one of many near copies, though some cells hold many, and a few candidates come on each."""
    made = spark.range(1_000_000).select(F.xxhash64("id").alias("simhash"))
    base, rng = made.first().simhash % (1 << 64), np.random.default_rng(8)
    copies = {v - (1 << 64) if v >> 63 else v for v in (flipped(base, rng, 2) for _ in range(80))}
    classes = made.union(spark.createDataFrame([(v,) for v in copies], "simhash long")).distinct().cache()
    where, members = simhash.places(classes, crowd=16)  # a quarter of what it is
    enumerated = {r.simhash for r in members.collect()}
    assert len(enumerated - copies) < 20 and len(enumerated) > 32
    cells = where.groupBy("cell").agg(F.count("*").alias("n"))
    assert cells.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] < 20 * 1_000_000


def flipped(value, rng, most):
    return value ^ sum(1 << int(f) for f in rng.choice(64, int(rng.integers(1, most + 1)), replace=False))


def test_crowded_cells_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    values = {flipped(b, rng, 6) for b in base for _ in range(20)} | {flipped(base[0], rng, 3) for _ in range(150)}
    chain = base[1]
    for _ in range(60):  # each within four bits of the one before
        chain = flipped(chain, rng, 4)
        values.add(chain)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = {v: i for i, v in enumerate(sorted(values))}
    classes = spark.createDataFrame([(signed[v], i) for v, i in nodes.items()], "simhash long, node long").cache()
    for distance, crowd in ((4, 64), (4, 1), (3, 4)):
        truth = least_reachable([(i, j) for a, i in nodes.items() for b, j in nodes.items() if i < j and (a ^ b).bit_count() <= distance], nodes.values())
        assert {r.node: r.label for r in simhash.labelled(classes, distance, crowd).collect()} == truth


def test_pairs_of_a_group_of_near_copies_dont_grow_with_its_square(spark):
    rng = np.random.default_rng(6)
    base, made = int(rng.integers(0, 1 << 62)), {}
    for n in (300, 1200):
        values = sorted({flipped(base, rng, 2) for _ in range(n)})
        df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "simhash long")
        made[len(values)] = simhash.links(*simhash.places(df)).distinct().count()  # a pair may meet in several cells
    (n, few), (m, many) = sorted(made.items())
    assert many / m <= few / n < simhash.CROWD


def test_components_of_chains_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(120)] + [(5, 5)]
    found = {r.u: r.label for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    truth = least_reachable(edges, {x for e in edges for x in e})
    assert all(found.get(n, n) == m for n, m in truth.items())


def test_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.drop_near_duplicates(odd).collect()
    assert sum(r.doc_id == 3 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    twice = odd.where("doc_id = 4").union(odd.where("doc_id = 4").withColumn("text", F.lit("a lesser text")))
    assert [r.text for r in simhash.drop_near_duplicates(twice.repartition(3)).collect()] == ["a lesser text"]
