"""Operator 7: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is read as 32 segments of two bits. The bit counts of the segments are a
point on a grid, and the Manhattan distance of two points never exceeds the number of
differing bits. Cut into groups of segments, two points within distance four agree in all
groups but four at most. Each fingerprint therefore enters a cell for each choice of
groups that may agree (70 choices of 4 of 8 groups), a join on cells finds all
candidates, and the differing bits decide. More fingerprints take more and finer groups,
so that what lies in a cell by chance stays a few.

A cell's segments agree in their counts, and two of them at most differ in their bits
(01 and 10), which are two bits each. So a crowded cell (over CROWD fingerprints) is
parted again by the bits themselves, of each third of its segments: chance neighbours
part, near copies remain. Only a part that is crowded still has near copies in numbers.

Equal fingerprints are one class before anything is joined, so copies are never
expanded into pairs. Nor are the members of such crowded parts, whose pairs would grow
with the square of a group of near copies: they are linked through the 2,081 values
within two bits of each. Two fingerprints are within four bits if and only if they have
such a value in common, so a value ties the least and the largest component that reach
it, again and again until each value has one. That takes time in proportion to the
members, and loses no link.

Defined cases: a null text is an empty one; a text without words has fingerprint
zero and is linked like any other; very long texts are hashed whole; rows that share a
doc_id are one document; a row without doc_id takes part, and its component has no number
if no row of it has; an empty table gives an empty result; only the named columns are
read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, chunks, cut

SEED = 42
CHUNK = 1_000_000
#: Fingerprints from which a cell is parted, and its parts' pairs aren't formed; crowded cells up to which their list is sent to every task.
CROWD = 64
BROADCAST_CELLS = 100_000
#: Groups of segments, and the number of fingerprints up to which they are enough.
GROUPS = {8: 1 << 25, 10: 1 << 30, 12: 1 << 63}
#: Nodes without a doc_id are numbered from here on.
NAMELESS = 1 << 62


def _hashes(text: str, shingle: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())]


def fingerprints_of(texts: list[str], shingle: int = 4) -> np.ndarray:
    """Fingerprints as unsigned 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in chunks([len(t) for t in texts], CHUNK):
        hashes = [_hashes(t, shingle) for t in texts[a:b]]
        sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
        some = np.flatnonzero(sizes)
        if not len(some):
            continue
        flat = np.array([h for hs in hashes for h in hs], np.uint64).astype(">u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
        ones = 2 * counts > sizes[some][:, None]
        out[a + some] = np.packbits(ones, axis=1).view(">u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, output: str = "simhash", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a signed 64-bit number."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            return [pa.array(fingerprints_of([t or "" for t in column.to_pylist()], shingle).view(np.int64))]

        return run

    return append_arrow(df, [text], [T.StructField(output, T.LongType(), False)], make, keep)


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _signed(numbers: Iterable[int]) -> Column:
    """An array of 64-bit numbers."""
    return F.expr(f"array({', '.join(f'bigint({m - (1 << 64) if m >> 63 else m})' for m in numbers)})")


def _choices(distance: int, groups: int) -> list[list[int]]:
    """The segments of each choice of groups that agree if no more than ``distance`` of them don't."""
    own = [[s for s in range(32) if s * groups // 32 == g] for g in range(groups)]
    return [[s for g in chosen for s in own[g]] for chosen in combinations(range(groups), groups - distance)]


def _mask(segments: Iterable[int]) -> int:
    return sum(3 << 2 * s for s in segments)


def _placed(classes: DataFrame, distance: int, groups: int) -> DataFrame:
    """Each fingerprint in a cell for each choice of groups: simhash, choice, cell."""
    ones = F.expr("bigint(6148914691236517205)")  # the lower bit of each segment
    low, high = F.col("simhash").bitwiseAND(ones), F.shiftrightunsigned("simhash", 1).bitwiseAND(ones)
    point = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sums: two bits hold a count of 0 to 2
    # What isn't chosen is all ones, which no count is, so cells of different choices differ.
    others = _signed(_mask(range(32)) ^ _mask(c) for c in _choices(distance, groups))
    return classes.select("simhash", F.posexplode(F.transform(others, lambda m: point.bitwiseOR(m))).alias("choice", "cell"))


def _parted(placed: DataFrame, distance: int, groups: int) -> DataFrame:
    """Places (simhash, cell) by the bits of each part of a cell's segments; a hash, as a chance meeting is only one more candidate."""
    n = distance // 2 + 1
    thirds = [_signed(_mask(c[k::n]) for c in _choices(distance, groups)) for k in range(n)]
    part = lambda k: F.xxhash64("cell", F.lit(k), F.col("simhash").bitwiseAND(F.get(thirds[k], F.col("choice"))))
    return placed.select("simhash", F.explode(F.array(*[part(k) for k in range(n)])).alias("cell"))


def _crowded(placed: DataFrame, crowd: int) -> DataFrame:
    return cut(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("cell"))


def _by_cells(placed: DataFrame, cells: DataFrame, how: str) -> DataFrame:
    return placed.join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, "cell", how)


def places(classes: DataFrame, distance: int = 4, crowd: int = CROWD, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Where fingerprints meet all others near them (simhash, cell), and the members of crowded places, which are left out of the first."""
    if not 0 <= distance <= 4:
        raise ValueError("the grid finds fingerprints within 4 bits")
    n = classes.count()
    groups = groups or next(g for g, most in GROUPS.items() if n <= most)
    placed = _placed(classes, distance, groups)
    full = _crowded(placed, crowd)
    parted = _parted(_by_cells(placed, full, "left_semi"), distance, groups)
    fuller = _crowded(parted, crowd)
    members = cut(_by_cells(parted, fuller, "left_semi").select("simhash").distinct())
    return _by_cells(placed.select("simhash", "cell"), full, "left_anti").unionByName(_by_cells(parted, fuller, "left_anti")), members


def links(where: DataFrame, members: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of different fingerprints within ``distance`` bits that meet in ``places``, of which one at least isn't among ``members``; a pair may come more than once."""
    marked = where.join(members.withColumn("crowded", F.lit(True)), "simhash", "left") if not members.isEmpty() else where.withColumn("crowded", F.lit(None).cast("boolean"))
    a, b = (marked.select(F.col("simhash").alias(n), "cell", F.coalesce("crowded", F.lit(False)).alias(f"{n}_crowded")) for n in "ab")
    near = (F.col("a") < F.col("b")) & ~(F.col("a_crowded") & F.col("b_crowded")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return a.join(b, (a.cell == b.cell) & near).select("a", "b")


def _masks(bits: int) -> Column:
    """An array of all 64-bit numbers of at most ``bits`` ones."""
    return _signed(sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(64), n))


def ties(members: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs of different labels of ``members`` (simhash, label) that a value near both has as its least and largest.

    A value is near if half of ``distance`` bits differ; for an odd distance one side goes a bit further.
    """
    centre = lambda bits: members.select(F.explode(F.transform(_masks(bits), lambda m: F.col("simhash").bitwiseXOR(m))).alias("centre"), "label")
    half = distance // 2
    near = centre(half).groupBy("centre").agg(F.min("label").alias("u"), F.max("label").alias("v"))
    if distance % 2:
        wide = centre(half + 1).groupBy("centre").agg(F.min("label").alias("u"), F.max("label").alias("v"))
        near = near.join(wide.toDF("centre", "p", "q"), "centre").select(F.least("u", "p").alias("u"), F.greatest("v", "q").alias("v"))
    return near.where("u <> v").select("u", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (u, v), by star contraction.

    In turn every node's larger neighbours, and then its smaller ones, are tied to the
    least of them all. The edges, which soon are one for each node, stop changing as a
    star around the smallest node of each component.
    """
    with_own = lambda e: e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e")).select("e.u", "e.v")
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return with_own(now).select("u", F.col("v").alias("label")).distinct()
        seen = mark
        least = with_own(now).groupBy("u").agg(F.min("v").alias("m"))
        large = cut(now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())


def labelled(classes: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """``classes`` (simhash, node; kept) with label, the least node of each one's component."""
    where, members = places(classes, distance, crowd)
    found = links(where, members, distance).distinct()
    named, other = classes.toDF("a", "u"), classes.toDF("b", "v")
    edges = cut(found.join(named, "a").join(other, "b").select("u", "v"))
    crowded = not members.isEmpty()
    while True:
        least = components(edges)
        out = cut(classes.join(least.withColumnRenamed("u", "node"), "node", "left").select("simhash", "node", F.coalesce("label", "node").alias("label")))
        if not crowded:
            return out
        more = cut(ties(out.join(members, "simhash", "left_semi").select("simhash", "label"), distance))
        if more.isEmpty():
            return out
        edges = edges.unionByName(more)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """For each row: doc_id (``key``), simhash and component_id, the smallest doc_id linked to it, itself included."""
    marked = cut(fingerprints(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle, keep=["doc_id"]))
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned("simhash", 2)
    classes = cut(marked.groupBy("simhash").agg(F.min("doc_id").alias("node")).select("simhash", F.coalesce("node", nameless).alias("node")))
    joined = labelled(classes, distance).select("simhash", F.col("label").alias("component"))
    component = F.when(F.col("component") < NAMELESS, F.col("component"))
    return marked.join(joined, "simhash").select("doc_id", "simhash", component.alias("component_id"))


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``df`` with one document of each component, that with the smallest ``key``; of rows that share it the one with the least text, then the least other columns. Rows without a key stay."""
    kept = near_duplicates(df, text, key, shingle, distance).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    order = [F.col(f"`{c}`") for c, kind in [(text, ""), *df.dtypes] if c != key and not kind.startswith("map")]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    one = df.join(kept, key, "left_semi").withColumn("__first", first).where("__first = 1").drop("__first")
    return one.select(*df.columns).unionByName(df.where(F.col(key).isNull()))
