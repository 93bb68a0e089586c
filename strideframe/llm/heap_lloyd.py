"""Operator 13: compression of vectors to codes by product quantisation, trained by a heap Lloyd.

Vectors of whole numbers are cut into equal parts, and each part position has a codebook
of entries. A round assigns every part to its nearest entry, then moves each entry to
the floor of its parts' mean. The vectors lie in blocks that stay where they are from
round to round, with a heap for each entry of a block: a part's key is how much farther
its second nearest entry is than its nearest one. An entry's drift grows each round by
its own way and the longest way of another one; as long as a part's key is above what
the drift has grown since, no other entry can be as near. So a round pops from each heap
the parts whose bounds the drift has violated, compares these with all entries exactly,
as integers, and pushes them onto the heaps of their entries. All other parts are not
looked at.

Only sums leave a block (a row for each entry and task), and only codebooks are sent to
the blocks: both bounded by the number of entries. The state of a round is kept in the
shared checkpoint folder, from which lost executors' blocks are made again.

Defined cases: rows with a null vector or a null or non-finite component are dropped;
ties go to the entry with the lower index; repeated rows count each for itself; rows
without an id begin no codebook unless there are too few with one, and with fewer rows
than entries there are as many entries as rows; short vectors, and those whose length the
number of parts doesn't divide, go on with zeros; components are held within 2^26; an
empty table gives an empty result; only the named columns are read, so others may have
any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, on_workers
from .hard_negatives import whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE, MOST = 4, 256, 4, 1024, 1 << 26
#: Vectors of a block at most, and distances computed at a time.
BLOCK = 8192
DISTANCES = 1 << 20
#: Labels up to which their sums are sent to every task.
BROADCAST_LABELS = 100_000
#: Doubles hold integers up to this one exactly.
EXACT = 1 << 53

Heap = list[tuple[float, int]]


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each part to each entry, as exact integers (held as doubles if these hold them exactly)."""
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * parts.shape[1] * top * top < EXACT else np.int64
    x, c = parts.astype(kind), entries.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part the nearest entry, the lower one of equals; its distance, and that of the second nearest."""
    at, first, second = np.zeros(len(parts), np.int64), np.zeros(len(parts)), np.full(len(parts), np.inf)
    step = max(1, DISTANCES // max(1, len(entries)))
    for a in range(0, len(parts), step):
        d = distances(parts[a : a + step], entries)
        own = slice(a, a + len(d))
        rows = np.arange(len(d))
        at[own] = d.argmin(axis=1)
        first[own] = np.sqrt(d[rows, at[own]])
        if d.shape[1] > 1:
            second[own] = np.sqrt(np.partition(d, 1, axis=1)[:, 1])
    return at, first, second


class Heaps:
    """A block's parts of one position: their entries, and a heap of (key, part) for each entry."""

    def __init__(self, near: np.ndarray, heaps: list[Heap]) -> None:
        self.near, self.heaps = near, heaps

    @classmethod
    def of(cls, parts: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> Heaps:
        found = cls(np.zeros(len(parts), np.int64), [[] for _ in entries])
        found._put(np.arange(len(parts)), parts, entries, drift)
        for heap in found.heaps:
            heapify(heap)
        return found

    def _put(self, which: np.ndarray, parts: np.ndarray, entries: np.ndarray, drift: np.ndarray, push=list.append) -> None:
        at, first, second = nearest(parts[which], entries)
        self.near[which] = at
        # Less what rounding may have added to the slack, or taken from a drift.
        keys = second - first - 1e-9 * (1 + first + np.where(np.isinf(second), 0, second)) + drift[at]
        for entry, key, part in zip(at.tolist(), keys.tolist(), which.tolist()):
            push(self.heaps[entry], (key, part))

    def advance(self, parts: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> int:
        """Assigns to moved entries, whose drift has grown to ``drift``; the number of parts that had to be rescanned."""
        popped = []
        for heap, moved in zip(self.heaps, drift.tolist()):
            while heap and heap[0][0] <= moved:
                popped.append(heappop(heap)[1])
        if popped:
            self._put(np.array(popped), parts, entries, drift, heappush)
        return len(popped)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        flat = [x for heap in self.heaps for x in heap]
        keys, parts = zip(*flat) if flat else ((), ())
        return np.array(keys, np.float64).tobytes(), np.array(parts, np.int32).tobytes(), np.array([len(h) for h in self.heaps], np.int32).tobytes()

    @classmethod
    def unpacked(cls, n: int, keys: bytes, parts: bytes, sizes: bytes) -> Heaps:
        flat = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(parts, np.int32).tolist()))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        heaps = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        near = np.zeros(n, np.int64)
        near[np.frombuffer(parts, np.int32)] = np.repeat(np.arange(len(heaps)), np.frombuffer(sizes, np.int32))
        return cls(near, heaps)


_HEAP = pa.struct([("keys", pa.binary()), ("parts", pa.binary()), ("sizes", pa.binary())])
_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("heaps", pa.list_(_HEAP)), ("rescanned", pa.int64())])
_STATE_DDL = "ids array<long>, labels array<long>, vectors binary, heaps array<struct<keys: binary, parts: binary, sizes: binary>>, rescanned long"
_CODES = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])
_CODES_DDL = "id long, label long, code string, error long"
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_SUMS_DDL = "part int, entry int, n long, sums array<long>"


class Codebooks:
    """The entries of all part positions (a list of arrays of whole numbers), and how far each has drifted in all."""

    def __init__(self, entries: list[np.ndarray], drift: list[np.ndarray] | None = None) -> None:
        self.entries = entries
        self.drift = [np.zeros(len(e)) for e in entries] if drift is None else drift

    def moved(self, sums: dict[tuple[int, int], tuple[int, Sequence[int]]]) -> Codebooks:
        """With each entry at the floor of its parts' mean; ``sums`` has the number and the sum of the parts of each used one."""
        new, drift = [e.copy() for e in self.entries], []
        for (part, entry), (n, total) in sums.items():
            new[part][entry] = [t // n for t in total]
        for old, now, before in zip(self.entries, new, self.drift):
            way = np.array([math.sqrt(sum(int(x) ** 2 for x in row)) for row in now - old]) * (1 + 1e-9)
            rank = np.sort(np.append(way, 0.0))[::-1]
            other = np.where(way == rank[0], rank[1], rank[0]) if len(way) > 1 and (way == rank[0]).sum() == 1 else rank[0]
            drift.append(before + way + other)
        return Codebooks(new, drift)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def _vectors(packed: bytes, n: int, shape: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(packed, f"i{len(packed) // max(1, n * shape[0] * shape[1])}" if packed else "i4").reshape(n, *shape)


def _blocks(shape: tuple[int, int], books: Codebooks):
    """Rows (id, label, v) to blocks in their first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                lists = batch.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = np.zeros((len(sizes), shape[0] * shape[1]), np.int32)
                flat[np.arange(flat.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(len(sizes), *shape)
                small = np.int16 if np.abs(flat).max(initial=0) < 1 << 15 else np.int32
                heaps = [Heaps.of(vectors[:, p], books.entries[p], books.drift[p]).packed() for p in range(shape[0])]
                yield _state([(batch.column(0).to_pylist(), batch.column(1).to_pylist(), vectors.astype(small).tobytes(), heaps, len(sizes) * shape[0])])

    return run


def _state(rows: list[tuple]) -> pa.RecordBatch:
    named = [(i, k, v, [dict(zip(("keys", "parts", "sizes"), h)) for h in heaps], n) for i, k, v, heaps, n in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*named), _STATE)], schema=_STATE)


def _read(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> Iterator[tuple[list, list, bytes, np.ndarray, list[Heaps]]]:
    """The blocks of a state, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, packed, heaps, _ = (c[k].as_py() for c in batch.columns)
            yield ids, labels, packed, _vectors(packed, len(ids), shape), [Heaps.unpacked(len(ids), h["keys"], h["parts"], h["sizes"]) for h in heaps]


def _advance(shape: tuple[int, int], books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, packed, vectors, heaps in _read(batches, shape):
            n = sum(h.advance(vectors[:, p], books.entries[p], books.drift[p]) for p, h in enumerate(heaps))
            yield _state([(ids, labels, packed, [h.packed() for h in heaps], n)])

    return run


def _sums(shape: tuple[int, int], entries: int):
    """Number and sum of the parts of each entry, over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((shape[0], entries), np.int64), np.zeros((shape[0], entries, shape[1]), np.int64)
        for _, _, _, vectors, heaps in _read(batches, shape):
            for p, h in enumerate(heaps):
                n[p] += np.bincount(h.near, minlength=entries)
                np.add.at(total[p], h.near, vectors[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], schema=_SUMS)

    return run


def _codes(shape: tuple[int, int], books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, _, vectors, heaps in _read(batches, shape):
            near = np.stack([h.near for h in heaps], 1)
            error = np.zeros(len(ids), np.int64)
            for p in range(shape[0]):
                error += ((vectors[:, p].astype(np.int64) - books.entries[p][near[:, p]]) ** 2).sum(axis=1)
            digits = 2 * max(1, -(-(max(len(books.entries[0]), 2) - 1).bit_length() // 8))
            codes = ["".join(f"{c:0{digits}x}" for c in row) for row in near.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(codes, pa.string()), pa.array(error)], schema=_CODES)

    return run


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks, tuple[int, int]]:
    """The blocks in their last state (kept), the last codebooks and the shape of a vector's parts."""
    v = whole_numbers(F.col(f"`{vector}`"), scale, MOST)
    rows = on_workers(df).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v")).where("v is not null")
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    longest = (rows.agg(F.max(F.size("v"))).first()[0] or 0) if first else 0
    shape = (parts, -(-longest // parts))
    start = np.zeros((len(first), parts * shape[1]), np.int64)
    for at, r in enumerate(first):
        start[at, : len(r.v)] = r.v
    cut_up = start.reshape(len(first), *shape)
    books = Codebooks([cut_up[:, p].copy() for p in range(parts)])
    state = cut(rows.mapInArrow(_blocks(shape, books), _STATE_DDL))
    for _ in range(rounds):
        sums = state.mapInArrow(_sums(shape, len(first)), _SUMS_DDL).groupBy("part", "entry")
        whole = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(shape[1])]).collect()
        books = books.moved({(r.part, r.entry): (r.n, [r[f"s{i}"] for i in range(shape[1])]) for r in whole})
        state = cut(state.mapInArrow(_advance(shape, books), _STATE_DDL))
    return state, books, shape


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """For each kept row: vec_id, code (the entries' indices in hex), error (its squared distance in all), label_error (that of all rows of its label) and codebooks_sha256."""
    state, books, shape = train(df, key, vector, label, **options)
    codes = state.mapInArrow(_codes(shape, books), _CODES_DDL)
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = cut(sums.withColumnRenamed("label", "its_label"))
    joined = codes.join(F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
