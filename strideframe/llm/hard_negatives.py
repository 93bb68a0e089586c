"""Operator 12: hard negatives by an orthogonal PCA rotation with early discarding.

Vectors are integers, and a score is their inner product. Rotated so that the leading
components carry most of it, a product's first components and the norms of the rest
bound the whole: it lies within the product of the rests' norms (and some slack for
rounding) of the partial product. A pair whose bound can't reach what is already known
is discarded after a part of the components; what survives all parts is multiplied as
integers, and only that decides.

Rows and anchors are dealt to square tiles, each anchor block against each row block,
so that no side is sent whole to any task and what is moved grows with the number of
tiles. A tile looks at few rows first, which gives bounds that discard most of the next,
larger lot. It returns the best of each anchor, and the tiles' best are ranked again.
First come an anchor's nearest rows of its label, then, from their scores, the rows of
other labels in each score's window.

Rows of equal vector and label score alike, so of those only the first few by id can be
among the first few of any anchor: the others are left out before anything is moved,
and equal anchors are searched once. A group of copies therefore costs as much as a few rows.

Defined cases: rows with a null label, a null vector or a null or non-finite component
take no part; equal scores go by id, and rows without an id come last, as no anchors;
repeated rows are rows of their own, and an anchor leaves out only itself; short vectors
go on with zeros; components are held within what keeps a score within 55 bits (for 64
components 23 million); texts play no part; an empty table gives an empty result; only
the named columns are read, so others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, on_workers

#: Rows from which the rotation is fitted; any rotation gives the same result, only sooner or later.
SAMPLE = 4096
#: Rows and anchors of a tile at most, and rows to make a tile worth a task.
TILE = 65_536
LEAST_TILE = 4_096
#: Shares of the sample's energy that the components after each part may have.
RESTS = (0.5, 0.2, 0.08)
#: Anchors at a time in a tile, rows in a first and in a largest lot, and pairs multiplied at a time.
ANCHORS, FIRST_LOT, LARGEST_LOT, PAIRS = 1024, 64, 2048, 1 << 15
SCORE_BITS = 55


def whole_numbers(vector: Column, factor: int, most: int) -> Column:
    """Components times ``factor``, rounded down and held within ``most``; null if the vector or a component is null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    held = lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x.cast("double") * factor))).cast("int")
    return F.when(~F.exists(vector, odd), F.transform(vector, held))


def rotation(sample: np.ndarray) -> tuple[np.ndarray, tuple[int, ...]]:
    """The principal axes of ``sample`` as columns, and the numbers of components in which each part ends."""
    dim = sample.shape[1]
    if not len(sample) or not dim:
        return np.eye(dim), (dim,)
    energy, axes = np.linalg.eigh(sample.T @ sample)
    energy, axes = np.maximum(energy[::-1], 0), np.ascontiguousarray(axes[:, ::-1])
    rest = 1 - np.cumsum(energy) / (energy.sum() or 1.0)
    ends = {int(np.argmax(rest <= share)) + 1 for share in RESTS}
    return axes, (*sorted(e for e in ends if e < dim), dim)


class Rotated:
    """Rotated vectors, part by part, with the norms of what comes after each part."""

    def __init__(self, whole: np.ndarray, axes: np.ndarray, ends: tuple[int, ...]) -> None:
        self.whole = whole
        turned = whole.astype(np.float64) @ axes
        begins = (0, *ends[:-1])
        self.parts = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(begins, ends)]
        squares = turned**2
        # Rounding slack: far more than the errors of sums of products of doubles.
        self.slack = 1e-6 * np.sqrt(squares.sum(axis=1)) + 1e-6
        self.rests = [np.sqrt(squares[:, b:].sum(axis=1)) for b in ends]


def _survivors(a: Rotated, i: np.ndarray, b: Rotated, j: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (places in ``i`` and ``j``) that ``wanted`` keeps to the end, and their scores as integers.

    ``wanted(partial, bound, at)`` says which may be wanted of all pairs (``at`` is None) or of the pairs of these places in ``i`` and ``j``.
    """
    sa, sb = a.slack[i], b.slack[j]
    partial, pairs = np.zeros((len(i), len(j))), None
    for part, (pa_, pb) in enumerate(zip(a.parts, b.parts)):
        ra, rb = a.rests[part][i], b.rests[part][j]
        if pairs is None:
            partial += pa_[i] @ pb[j].T
            keep = wanted(partial, np.outer(ra, rb) + np.outer(sa, sb), None)
            if part + 1 < len(a.parts) and 8 * np.count_nonzero(keep) > keep.size:
                continue  # most are left: go on with all of them
            p, q = np.nonzero(keep)
            pairs, partial = (p, q), partial[p, q]
        else:
            p, q = pairs
            for lo in range(0, len(p), PAIRS):
                at = slice(lo, lo + PAIRS)
                partial[at] += np.einsum("nd,nd->n", pa_[i[p[at]]], pb[j[q[at]]])
            keep = np.flatnonzero(wanted(partial, ra[p] * rb[q] + sa[p] * sb[q], (p, q)))
            pairs, partial = (p[keep], q[keep]), partial[keep]
    p, q = pairs
    scores = np.empty(len(p), np.int64)
    for lo in range(0, len(p), PAIRS):
        at = slice(lo, lo + PAIRS)
        scores[at] = np.einsum("nd,nd->n", a.whole[i[p[at]]], b.whole[j[q[at]]])
    return p, q, scores


def _lots(n: int) -> Iterator[tuple[int, int]]:
    at, size = 0, FIRST_LOT
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(4 * size, LARGEST_LOT)


class Best:
    """The best ``k`` (score, id) of each of ``n`` owners; ``floor`` is the score that a new one has to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.least = k, floor
        self.owner, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = floor.copy()

    def add(self, owner: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """``row`` is a row's place in the order of ids."""
        owner, score, row = np.append(self.owner, owner), np.append(self.score, score), np.append(self.row, row)
        order = np.lexsort((row, -score, owner))
        owner, score, row = owner[order], score[order], row[order]
        new = np.append(True, owner[1:] != owner[:-1])
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0)) if len(owner) else owner
        kept = rank < self.k
        self.owner, self.score, self.row = owner[kept], score[kept], row[kept]
        last = rank[kept] == self.k - 1
        self.floor = self.least.copy()
        self.floor[self.owner[last]] = np.maximum(self.least[self.owner[last]], self.score[last])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class Tile:
    """A tile's anchors and rows, the rows in the order of their ids."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, axes: np.ndarray, ends: tuple[int, ...]) -> None:
        dim = len(axes)
        ids = rows.column("id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.ids = [ids[k] for k in order]
        self.labels = rows.column("label").to_numpy()[order]
        self.rows = Rotated(_matrix(rows.column("v"), dim)[order], axes, ends)
        self.anchors = anchors.column("anchor").to_numpy()
        self.own = anchors.column("label").to_numpy()
        self.queries = Rotated(_matrix(anchors.column("v"), dim), axes, ends)


_POSITIVES = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_NEGATIVES = pa.schema([("anchor", pa.int64()), ("positive_score", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_DDL = {"positives": "anchor long, score long, id long", "negatives": "anchor long, positive_score long, score long, id long"}


def _nearest(axes: np.ndarray, ends: tuple[int, ...], k: int):
    """Of each anchor of a tile the best ``k`` rows of its label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _POSITIVES.empty_table()
        tile, out = Tile(anchors, rows, axes, ends), []
        for label in np.intersect1d(tile.own, tile.labels):
            mine, there = np.flatnonzero(tile.own == label), np.flatnonzero(tile.labels == label)
            for lo in range(0, len(mine), ANCHORS):
                i = mine[lo : lo + ANCHORS]
                best = Best(len(i), k, np.full(len(i), np.iinfo(np.int64).min // 2))
                for a, b in _lots(len(there)):
                    j = there[a:b]
                    floor = best.floor.astype(np.float64)

                    def wanted(partial, bound, at, floor=floor):
                        return partial + bound >= (floor[:, None] if at is None else floor[at[0]])

                    p, q, scores = _survivors(tile.queries, i, tile.rows, j, wanted)
                    best.add(p, scores, j[q])
                out.append(pa.table([tile.anchors[i[best.owner]], best.score, pa.array([tile.ids[r] for r in best.row.tolist()], pa.int64())], schema=_POSITIVES))
        return pa.concat_tables(out) if out else _POSITIVES.empty_table()

    return run


def _in_windows(axes: np.ndarray, ends: tuple[int, ...], k: int, low: tuple[int, int], high: tuple[int, int]):
    """Of each anchor of a tile and each of its positives' scores the best ``k`` rows of other labels in the score's window."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _NEGATIVES.empty_table()
        tile, out = Tile(anchors, rows, axes, ends), []
        given = [sorted(s) for s in anchors.column("scores").to_pylist()]
        for lo in range(0, len(given), ANCHORS):
            i = np.arange(lo, min(lo + ANCHORS, len(given)))
            width = max(len(given[n]) for n in i)
            # A window for each score: an anchor with fewer has windows that nothing is in.
            scores = [[*given[n], *[None] * (width - len(given[n]))] for n in i]
            least = np.array([[1 << 62 if s is None else -(-low[0] * s // low[1]) for s in own] for own in scores], np.int64).reshape(len(i), width)
            most = np.array([[-(1 << 62) if s is None else high[0] * s // high[1] for s in own] for own in scores], np.int64).reshape(len(i), width)
            bests = [Best(len(i), k, least[:, w]) for w in range(width)]
            for a, b in _lots(len(tile.ids)):
                j = np.arange(a, b)
                other = tile.own[i][:, None] != tile.labels[j]
                floors = [x.floor.astype(np.float64) for x in bests]

                def wanted(partial, bound, at, other=other, floors=floors, most=most):
                    may = np.zeros(partial.shape, bool)
                    for w, floor in enumerate(floors):
                        top = most[:, w].astype(np.float64)
                        f, t = (floor[:, None], top[:, None]) if at is None else (floor[at[0]], top[at[0]])
                        may |= (partial + bound >= f) & (partial - bound <= t)
                    return may & (other if at is None else other[at])

                p, q, found = _survivors(tile.queries, i, tile.rows, j, wanted)
                for w, best in enumerate(bests):
                    inside = np.flatnonzero((found >= best.floor[p]) & (found <= most[p, w]))
                    best.add(p[inside], found[inside], j[q[inside]])
            for w, best in enumerate(bests):
                positive = np.array([scores[n][w] for n in best.owner.tolist()], np.int64)
                out.append(pa.table([tile.anchors[i[best.owner]], positive, best.score, pa.array([tile.ids[r] for r in best.row.tolist()], pa.int64())], schema=_NEGATIVES))
        return pa.concat_tables(out) if out else _NEGATIVES.empty_table()

    return run


def _tiled(anchors: DataFrame, rows: DataFrame, kernel, ddl: str) -> DataFrame:
    """``kernel`` on each block of ``anchors`` (anchor) against each block of ``rows`` (id, v)."""
    tasks = anchors.sparkSession.sparkContext.defaultParallelism
    n_anchors, n_rows = anchors.count(), rows.count()
    across, down = max(1, -(-n_anchors // TILE)), max(1, -(-n_rows // TILE), min(tasks, n_rows // LEAST_TILE))
    part = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = on_workers(anchors).withColumn("across", part(across, "anchor")).withColumn("down", each(down))
    right = rows.withColumn("down", part(down, "id", "v")).withColumn("across", each(across))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both may come from the same table
    return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(kernel, ddl)


def _first(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group; Spark drops what lies behind them before the exchange as well."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: tuple[int, int] = (1, 2),
    high: tuple[int, int] = (19, 20),
) -> DataFrame:
    """Of each anchor and each of its ``positives`` nearest rows of its label the first ``negatives`` rows of other labels that score at least ``low`` and at most ``high`` (fractions) of the positive's score.

    ``is_anchor`` is a condition on ``df``. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    own = df.select(F.col(f"`{key}`").cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    dim = df.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0
    most = math.isqrt((1 << SCORE_BITS) // max(dim, 1))
    base = cut(own.select("id", "label", whole_numbers(F.col("vector"), scale, min(most, (1 << 31) - 1)).alias("v"), "is_anchor").where("label is not null and v is not null"))
    # An anchor leaves itself out, so one more than are asked for may be needed.
    need = max(positives + 1, negatives)
    rows = cut(_first(base, need, ["label", "v"], [F.col("id").asc_nulls_last()]).select("id", "label", "v"))
    anchors = cut(base.where("is_anchor and id is not null").groupBy("label", "v").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("anchor"), "label", "v"))
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    fitted = np.zeros((len(sample), dim))
    for at, r in enumerate(sample):
        fitted[at, : len(r.v)] = r.v
    axes, ends = rotation(fitted)

    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    near = _tiled(anchors, rows, _nearest(axes, ends, positives + 1), _DDL["positives"])
    near = cut(_first(near, positives + 1, ["anchor"], best))
    windows = near.groupBy("anchor").agg(F.collect_set("score").alias("scores"))
    hard = _tiled(anchors.join(windows, "anchor"), rows, _in_windows(axes, ends, negatives, low, high), _DDL["negatives"])
    hard = _first(hard, negatives, ["anchor", "positive_score"], best)
    # Of each anchor, in order: the positives, each with its negatives; a few at most.
    lists = hard.groupBy("anchor", "positive_score").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))
    both = near.join(lists.withColumnRenamed("positive_score", "score"), ["anchor", "score"], "left")
    both = both.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "negatives"))).alias("found"))

    members = base.where("is_anchor and id is not null").select(F.col("id").alias("anchor_id"), "label", "v").join(anchors, ["label", "v"])
    product = F.aggregate(F.transform("v", lambda x: x.cast("long") * x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    found = members.select("anchor", "anchor_id", product.alias("itself")).join(both, "anchor")
    itself = F.transform("found", lambda x, k: F.when((x["id"] == F.col("anchor_id")) & (x["score"] == F.col("itself")), k))
    others = F.slice(F.filter("found", lambda x, k: F.col("at").isNull() | (k != F.col("at"))), 1, positives)
    rest = found.withColumn("at", F.array_min(itself)).select("anchor_id", F.explode(others).alias("p"))
    out = rest.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score", F.col("n.negative_score").alias("negative_score"))
