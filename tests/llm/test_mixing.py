import random
from collections import defaultdict

from pyspark.sql import functions as F
from strideframe.llm import mixing


def targets(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over


def test_mix_meets_targets(documents):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), "src0" if rng.random() < 0.4 else rng.choice(["b", "Ä", "z", "c", None, "tiny"])) for i in range(1500)]
    rows = [r for r in rows if r[2] != "tiny"] + [(9000, "just three words", "tiny"), (9001, None, "none")]
    found = mixing.mix(documents(rows)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.doc_id: r["size"] for r in found} == {i: len((t or "").split()) for i, t, _ in rows}
    for s, t in targets(sizes).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 4 * 32, s
    again = mixing.mix(documents(rows[::-1]).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in again}


def plain_taken(df):
    """Of the rows with words, by (doc_id, size, source), the words that a schedule in plain Python takes."""
    placed = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text")).alias("order"), F.xxhash64("text").alias("mark")).collect()
    sizes = defaultdict(int)
    for r in placed:
        sizes[r.source] += r["size"]
    goal, block = targets(sizes), 32
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    total, edges, upto = sum(goal.values()), [], 0.0
    for s in names:
        edges.append((s, round(upto / total * mixing.CIRCLE), round((upto + goal[s]) / total * mixing.CIRCLE)))
        upto += goal[s]
    blocks = defaultdict(int)
    for slot in range(-(-int(total * 1000) // (1000 * block))):
        point = slot * mixing.GOLDEN % mixing.CIRCLE
        blocks[next(s for s, a, b in edges if a <= point < b)] += 1
    want = defaultdict(list)
    for s in names:
        at = 0
        for r in sorted((r for r in placed if r.source == s and r["size"]), key=lambda r: ((r.order % (1 << 64)) >> (64 - mixing.HASH_BITS), r.doc_id or -1, r.mark)):
            got = sum(max(0, min(p * sizes[s] + at + r["size"], blocks[s] * block) - (p * sizes[s] + at)) for p in (0, 1))
            want[(r.doc_id, r["size"], s)].append(got)
            at += r["size"]
    return want


def test_taken_against_a_plain_schedule(documents):
    rng = random.Random(3)
    df = documents([(None if i % 4 == 0 else i, " ".join(f"w{i}" for _ in range(rng.randint(0, 70))), rng.choice(["a", "b", "b", "b", "Ä", None])) for i in range(700)])
    found = defaultdict(list)
    for r in mixing.mix(df).collect():
        if r["size"]:
            found[(r.doc_id, r["size"], r.source)].append(r.taken)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in plain_taken(df).items()}


def test_rows_without_a_doc_id_are_spread(documents):
    rows = documents([(None if i % 2 else i, f"text number {i}", "s") for i in range(6000)])
    sizes = rows.select(*mixing._sizes("text", "source", "doc_id"), F.lit(0).alias("number"), F.monotonically_increasing_id().alias("row"))
    largest = mixing.streams(sizes, 6000, 7).groupBy("number", "bucket").count().agg(F.max("count")).first()[0]
    assert largest < 120


def test_golden_points_are_spread(spark):
    slots = [*range(1000), (1 << 40) + 12345, (1 << 48) - 1, 1 << 50]
    found = [r.p for r in spark.createDataFrame([(i,) for i in slots], "id long").select(mixing.golden_point(F.col("id")).alias("p")).collect()]
    assert found == [i * mixing.GOLDEN % mixing.CIRCLE for i in slots]
    points = sorted(found[:1000])
    gaps = [b - a for a, b in zip(points, points[1:])]
    assert max(gaps) < 3 * mixing.CIRCLE / 1000 and mixing.GOLDEN % 2 == 1


def test_mixed_documents_hold_what_was_taken(documents):
    rng = random.Random(2)
    df = documents([(i, "\n ".join(f"w{k}" for k in range(rng.randint(1, 80))), f"s{i % 3}") for i in range(200)])
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {i: n for i, n in taken.items() if n}
    assert mixed.where(F.length("text") != F.col("n_chars")).count() == 0
    # A source gives its stream's beginning: of one document at most it gives a part, which is the text's beginning.
    parts = mixed.join(df.select("doc_id", F.col("text").alias("whole")), "doc_id").where("text <> whole").collect()
    assert len({r.source for r in parts}) == len(parts) and all(r.whole.startswith(r.text) for r in parts)


def test_a_tiny_share_is_met(documents):
    tiny, most = 40, 3_000_000
    sizes = documents([(1, None, "a"), (2, None, "b")]).select("doc_id", "source", F.when(F.col("source") == "b", tiny).otherwise(most).cast("long").alias("size"), F.col("doc_id").alias("row"), F.lit(0).alias("mark"))
    found = {r.source: r for r in mixing._taken(sizes).collect()}
    assert abs(found["b"].taken - found["b"].target) <= 64 and found["b"].target == 80


def test_rows_without_or_with_one_id_are_documents_of_their_own(documents):
    sizes = {None: (1000, 10, 301, 44, 7), 5: (20, 33, 90), 6: (2,)}
    df = documents([(i, " ".join(f"{n}x{k}" for k in range(n)), "src") for i, ns in sizes.items() for n in ns])
    taken = {r["size"]: r.taken for r in mixing.mix(df).collect()}
    assert 0 < sum(taken.values()) and len({t / n for n, t in taken.items()}) > 1
    emitted = defaultdict(list)
    for r in mixing.mixed_documents(df).collect():
        words = r.text.split()
        n = int(words[0].split("x")[0])
        assert words == [f"{n}x{k}" for k in range(len(words))] and n in sizes[r.doc_id]
        emitted[n].append(len(words))
    for n, t in taken.items():
        assert sorted(emitted[n], reverse=True) == [n] * (t // n) + [t % n] * (t % n > 0), n


def test_odd_rows(odd):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and all(r.taken == 0 for r in found if not r["size"])
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.where("text is null")).agg(F.sum("taken")).first()[0] == 0
