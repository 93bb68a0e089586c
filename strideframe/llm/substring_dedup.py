"""Operator 3: removal of passages that an earlier document has, by FM-indexes.

A window is 13 consecutive words of a document. Its anchor is the least hash among
its runs of seven words, so equal windows have equal anchors. The job has five parts:

1. Documents are dealt to blocks. A block sends each of its anchors once, as four
   bytes, to the anchor's shard.
2. A shard tells each block which of its anchors other blocks have as well, and which
   many have. That a window has such an anchor is needed for a match, not enough.
3. A block sends the words of its runs of windows with shared anchors to index shards,
   with the documents and places of each: a run goes by its anchor, and a window whose
   anchor is a common one by its own 13 words, so that no shard gathers a common phrase
   in all its contexts.
4. A shard looks its runs up. Of each anchor it indexes the runs of the earliest document
   that has it, as a compressed FM-index, and streams the runs of all other documents, each
   text once, through it: backward search over the wavelet matrix gives their matching
   statistics. Where a match of 13 words or more belongs to an earlier document, the
   interval is reported. Windows that found none go on to a next index of what is left:
   each by itself, the earliest document's indexed and the others streamed, which decides. No task gets the runs of more than FAN_IN blocks: with
   more of them than that, a shard's blocks are dealt to groups, each group sends its
   different runs once to the shard's index and gets back what was found for these.
5. Blocks remove the intervals.

Windows are judged on the input, and by the words themselves. Documents are dealt by
one exchange that parts 1, 3 and 5 share; nothing else of their size is moved.

Defined cases: a null text has no words; texts under 13 words keep all; very long texts are
read whole, in one block; of rows that share a doc_id none is earlier than the other; a row
without doc_id is later than all others; an empty table gives an empty result; kept columns
named as outputs give way to them, all others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, on_workers
from .fm_index import FmIndex
from .words import WordTable, mix

WINDOW = 13
ANCHOR = 7
#: Bytes of text in a block, blocks to a shard of anchors and of an index, windows in a run at most, windows from which an anchor is common.
BLOCK_BYTES = 2 << 20
BLOCKS_A_SHARD = 16
BLOCKS_AN_INDEX = 4
LONGEST_RUN = 64
COMMON = 16_384
#: Blocks whose runs one task takes in, words that are streamed at a time, and indexes by anchors before those by windows.
FAN_IN = 4096
CHUNK_WORDS = 1 << 20
ROUNDS = 1
NO_ID = np.iinfo(np.int64).max

_STEP = np.uint64(0x9E3779B97F4A7C15)

OUTPUTS = {
    "n_words": T.LongType(),
    "n_removed": T.LongType(),
    "kept_sha256": T.StringType(),
    "kept_text": T.StringType(),
    "removed_spans": T.ArrayType(T.ArrayType(T.IntegerType())),
}
_ARROW = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(), "removed_spans": pa.list_(pa.list_(pa.int32()))}


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` neighbours."""
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total = total * _STEP + h[k : len(h) - n + 1 + k]
    return mix(total)


def in_order(ids: np.ndarray, texts: Sequence[str]) -> list[int]:
    """A block's rows by id, then by text: the same whenever and however they come."""
    return sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))


class Block:
    """A block's documents in order of doc_id, and its windows with their anchors."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("__id").to_numpy(zero_copy_only=False)
        texts = [t or "" for t in table.column("__text").to_pylist()]
        order = in_order(ids, texts)
        self.ids = ids[order].astype(np.int64)
        self.words = WordTable([texts[i] for i in order])
        first = self.words.first
        counts = np.maximum(np.diff(first) - WINDOW + 1, 0)
        total = int(counts.sum())
        #: Each window's document and first word.
        self.doc = np.repeat(np.arange(len(order)), counts)
        self.at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
        if total:
            grams = _rolled(self.words.hashes, ANCHOR)
            least = grams[: len(grams) - WINDOW + ANCHOR].copy()
            for k in range(1, WINDOW - ANCHOR + 1):
                np.minimum(least, grams[k : k + len(least)], out=least)
            self.anchor = least[self.at]
            self.whole = _rolled(self.words.hashes, WINDOW)[self.at]
        else:
            self.anchor = self.whole = np.zeros(0, np.uint64)
        self.keys, self.key_of = np.unique(self.anchor, return_inverse=True)

    def different_windows(self) -> np.ndarray:
        """How many different windows each key is the anchor of."""
        return np.bincount(self.key_of[np.unique(self.whole, return_index=True)[1]], minlength=len(self.keys))

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of the keys by shard, the shards that have any, and where each begins."""
        shard = (self.keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        found, begins = np.unique(shard[order], return_index=True)
        return order, found, np.append(begins, len(order))

    def shared(self, shards: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which keys more than one document may have, and which are common."""
        order, found, begins = self.by_shard(shards)
        shared, common = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for s, a, b in zip(found.tolist(), begins, begins[1:]):
            bits = np.unpackbits(np.frombuffer(answers[s], np.uint8), count=2 * (b - a)).astype(bool)
            shared[order[a:b]], common[order[a:b]] = bits[: b - a], bits[b - a :]
        low, high = np.full(len(self.keys), len(self.ids)), np.full(len(self.keys), -1)
        np.minimum.at(low, self.key_of, self.doc)
        np.maximum.at(high, self.key_of, self.doc)
        return shared | (low != high), common

    def runs(self, shards: int, answers: dict[int, bytes], index_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Runs of windows to be looked up: the first window, a hash of the anchor (or of the window, if that is common), the index shard and the words."""
        shared, common = self.shared(shards, answers)
        go = np.flatnonzero(shared[self.key_of])
        if not len(go):
            return go, go.astype(np.uint32), go, []
        alone = common[self.key_of[go]]
        new = np.ones(len(go), bool)
        new[1:] = (go[1:] != go[:-1] + 1) | (self.key_of[go[1:]] != self.key_of[go[:-1]]) | (self.doc[go[1:]] != self.doc[go[:-1]]) | alone[1:]
        begins = np.flatnonzero(new)
        within = np.arange(len(go)) - np.repeat(begins, np.diff(np.append(begins, len(go))))
        begins = np.flatnonzero(within % LONGEST_RUN == 0)
        sizes = np.diff(np.append(begins, len(go)))
        first = go[begins]
        route = np.where(alone[begins], self.whole[first], mix(self.anchor[first]))
        a, b = self.words.starts[self.at[first]], self.words.ends[self.at[first] + sizes + WINDOW - 2]
        data = self.words.data
        texts = [b" ".join(data[i:j].split()) for i, j in zip(a.tolist(), b.tolist())]
        return first, (mix(route) >> np.uint64(32)).astype(np.uint32), (route % np.uint64(index_shards)).astype(np.int64), texts

    def parcels(self, *args) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """For each index shard its distinct runs' words and anchors; and of each run which of them it is, its document and first word; and the document's id."""
        first, key, shard, texts = self.runs(*args)
        docs = self.doc[first]
        places = np.stack((docs, self.at[first] - self.words.first[docs]), 1) if len(first) else np.zeros((0, 2), np.int64)
        order = np.argsort(shard, kind="stable")
        found, begins = np.unique(shard[order], return_index=True)
        for s, a, b in zip(found.tolist(), begins, np.append(begins[1:], len(order))):
            known: dict[bytes, int] = {}
            own = order[a:b]
            which = [known.setdefault(texts[i], len(known)) for i in own.tolist()]
            keys = np.zeros(len(known), np.uint32)
            keys[which] = key[own]
            yield s, list(known), keys, np.column_stack((which, places[own])).astype(np.int32), self.ids[docs[own]]


def _binary_table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


_ANCHORS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("anchors", pa.binary()), ("windows", pa.binary())])
_ANCHORS_DDL = "block int, shard int, anchors binary, windows binary"
_ANSWERS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())])
_ANSWERS_DDL = "block int, shard int, bits binary"
_RUNS = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("runs", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("ids", pa.binary())])
_RUNS_DDL = "block int, shard int, runs binary, keys binary, places binary, ids binary"
_TEXT = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("runs", pa.binary()), ("keys", pa.binary()), ("least", pa.binary()), ("greatest", pa.binary())])
_TEXT_DDL = "shard int, part int, runs binary, keys binary, least binary, greatest binary"
_OWNERS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("owners", pa.binary())])
_OWNERS_DDL = "shard int, part int, owners binary"
_FOUND = pa.schema([("block", pa.int32()), ("intervals", pa.binary())])
_FOUND_DDL = "block int, intervals binary"


def _answers(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("shard").to_pylist(), table.column("bits").to_pylist()))


def _send_anchors(shards: int):
    def run(table: pa.Table) -> pa.Table:
        block, number = Block(table), table.column("block")[0].as_py()
        order, found, begins = block.by_shard(shards)
        short = (block.keys[order] >> np.uint64(32)).astype(np.uint32)
        windows = np.minimum(block.different_windows()[order], 65535).astype(np.uint16)
        return _binary_table(_ANCHORS, [(number, s, short[a:b].tobytes(), windows[a:b].tobytes()) for s, a, b in zip(found.tolist(), begins, begins[1:])])

    return run


def _answer_anchors(common: int):
    def run(table: pa.Table) -> pa.Table:
        blocks, shard = table.column("block").to_pylist(), table.column("shard")[0].as_py()
        keys = [np.frombuffer(b, np.uint32) for b in table.column("anchors").to_pylist()]
        windows = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("windows").to_pylist()])
        which = np.unique(np.concatenate(keys), return_inverse=True)[1]
        several = (np.bincount(which) > 1)[which]
        many = (np.bincount(which, windows) > common)[which]
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(np.concatenate((several[e - len(k) : e], many[e - len(k) : e]))).tobytes() for k, e in zip(keys, ends)]
        return _binary_table(_ANSWERS, [(n, shard, b) for n, b in zip(blocks, bits)])

    return run


def _packed(a: np.ndarray) -> bytes:
    """An array's columns, as steps from row to row."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(a, axis=0, prepend=np.zeros_like(a[:1])).T.tobytes())


def _unpacked(packed: bytes, kind: type, columns: int = 1) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)
    a = np.cumsum(steps.reshape(columns, -1), axis=1, dtype=kind)
    return a.T if columns > 1 else a[0]


def _packed_runs(runs: Sequence[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(runs))


def _unpacked_runs(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b"\n")


def _send_runs(shards: int, index_shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _binary_table(_RUNS, [])
        number = left.column("block")[0].as_py()
        parcels = Block(left).parcels(shards, _answers(right), index_shards)
        return _binary_table(_RUNS, [(number, s, _packed_runs(texts), keys.tobytes(), _packed(places), _packed(ids)) for s, texts, keys, places, ids in parcels])

    return run


class Text:
    """Distinct runs, each with its anchor, and the least and the greatest id that came with it."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, runs: Sequence[bytes], keys: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Takes runs; their numbers among the distinct ones."""
        known = self.known
        number = np.array([known.setdefault(r, len(known)) for r in runs], np.int64)
        self.parts.append((number, keys, least, greatest))
        return number

    def add_places(self, runs: Sequence[bytes], keys: np.ndarray, which: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes runs, and of each place the run and the id."""
        least, greatest = np.full(len(runs), NO_ID), np.full(len(runs), np.iinfo(np.int64).min)
        np.minimum.at(least, which, ids)
        np.maximum.at(greatest, which, ids)
        return self.add(runs, keys, least, greatest)

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.known)
        keys, least, greatest = np.zeros(n, np.uint32), np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
        for number, k, low, high in self.parts:
            keys[number] = k
            np.minimum.at(least, number, low)
            np.maximum.at(greatest, number, high)
        return keys, least, greatest

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """The owners of all windows that a shard finds, and where each run's windows begin."""
        runs = list(self.known)
        sizes = np.fromiter((r.count(b" ") for r in runs), np.int64, len(runs)) + 2 - WINDOW
        return Shard(runs, *self.columns()).owners(), np.append(0, np.cumsum(sizes))


def _streams(table: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    for runs, keys, places, ids in zip(*(table.column(n).to_pylist() for n in ("runs", "keys", "places", "ids"))):
        yield _unpacked_runs(runs), np.frombuffer(keys, np.uint32), _unpacked(places, np.int32, 3), _unpacked(ids, np.int64)


def _text_of_streams(table: pa.Table) -> pa.Table:
    """A group's different runs."""
    text = Text()
    for runs, keys, places, ids in _streams(table):
        text.add_places(runs, keys, places[:, 0], ids)
    keys, least, greatest = text.columns()
    return _binary_table(_TEXT, [(table.column("shard")[0].as_py(), table.column("part")[0].as_py(), _packed_runs(list(text.known)), keys.tobytes(), _packed(least), _packed(greatest))])


def _owners_of_texts(table: pa.Table) -> pa.Table:
    """For each group of a shard the owners of its own runs' windows."""
    text, numbers = Text(), []
    for runs, keys, least, greatest in zip(*(table.column(n).to_pylist() for n in ("runs", "keys", "least", "greatest"))):
        numbers.append(text.add(_unpacked_runs(runs), np.frombuffer(keys, np.uint32), _unpacked(least, np.int64), _unpacked(greatest, np.int64)))
    owners, begins = text.owners()
    out = []
    for part, number in zip(table.column("part").to_pylist(), numbers):
        n = begins[number + 1] - begins[number]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[number], n)
        out.append((table.column("shard")[0].as_py(), part, _packed(owners[at])))
    return _binary_table(_OWNERS, out)


def _words_of(runs: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all runs, and how many each run has."""
    data = b"\n".join(runs)
    a = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(a == 10), len(a))
    upto = np.searchsorted(np.flatnonzero((a == 32) | (a == 10)), ends) + 1
    return data.replace(b"\n", b" ").split(b" "), np.diff(upto, prepend=0)


class Shard:
    """A shard's distinct runs, with each one's anchor and the least and the greatest id that has it."""

    def __init__(self, runs: Sequence[bytes], keys: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        words, sizes = _words_of(runs)
        known = {w: i for i, w in enumerate(set(words), 1)}
        self.symbols = len(known) + 1
        self.words = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        #: Pieces of runs: first word, number of words, anchor, id, and whether other documents have them as well.
        self.pieces = (starts, sizes, keys.astype(np.int64), least, greatest > least)
        counts = np.maximum(sizes - WINDOW + 1, 0)
        self.windows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
        #: What was looked up, and what of it wasn't whole, for tests and figures.
        self.streamed = self.broken = 0

    def index(self, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> FmIndex:
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.zeros(sizes.sum() + len(sizes), np.int64)
        text[inside + np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes)] = self.words[inside + np.repeat(starts, sizes)]
        return FmIndex(text, self.symbols, WINDOW, np.repeat(ids, sizes + 1))

    def owners(self) -> np.ndarray:
        """Of each window an id of an earlier document, if there is one, else that of the first or NO_ID; run after run."""
        owner = np.full(len(self.words), NO_ID)
        starts, sizes, keys, ids, several = self.pieces
        rounds = 0
        while len(starts):
            if rounds >= ROUNDS:
                starts, sizes, keys, ids, several = self._single(starts, sizes, ids, several)
            which, first_of = np.unique(keys, return_inverse=True)
            least, n = np.full(len(which), NO_ID), np.bincount(first_of)
            np.minimum.at(least, first_of, ids)
            shared = (n > 1)[first_of] | several
            first = ids == least[first_of]
            indexed, sent = np.flatnonzero(shared & first), np.flatnonzero(shared & (~first | several))
            if not len(sent):
                break
            index = self.index(starts[indexed], sizes[indexed], ids[indexed])
            for a, b in chunks(sizes[sent].tolist(), CHUNK_WORDS):
                self._stream(index, starts[sent[a:b]], sizes[sent[a:b]], owner)
            left = np.flatnonzero(shared & ~first)
            starts, sizes, keys, ids, several = self._unresolved(owner, starts[left], sizes[left], keys[left], ids[left], several[left])
            rounds += 1
        return owner[self.windows]

    def _stream(self, index: FmIndex, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> None:
        own = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(own, sizes) + np.repeat(starts, sizes)
        length, group = index.matching(self.words[at], own, sizes)
        whole = length == WINDOW
        found = np.flatnonzero(whole)
        owner[at[found]] = np.minimum(owner[at[found]], index.least[group[found]])
        self.streamed += len(at)
        self.broken += int((~whole).sum() - (WINDOW - 1) * len(sizes))

    @staticmethod
    def _unresolved(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is left of pieces: neighbouring windows without an earlier owner."""
        n = sizes - WINDOW + 1
        piece = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        left = np.flatnonzero(owner[at] >= more[1][piece])
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (piece[left[1:]] != piece[left[:-1]])
        begins = np.flatnonzero(new)
        lengths = np.diff(np.append(begins, len(left)))
        return at[left[begins]], lengths + WINDOW - 1, *(m[piece[left[begins]]] for m in more)

    def _single(self, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces' windows, each by itself, under a hash of its words."""
        n = sizes - WINDOW + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        key = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            key = mix(key * _STEP + self.words[at + k].astype(np.uint64))
        return at, np.full(len(at), WINDOW), key.view(np.int64), np.repeat(ids, n), np.repeat(several, n)


def _intervals(least: np.ndarray, begins: np.ndarray, number: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The intervals (document, first word, end) of a block's places that an earlier document has; ``number`` is each run's, and ``begins`` where a run's windows begin in ``least``."""
    own = number[places[:, 0]]
    n = begins[own + 1] - begins[own]
    member = np.repeat(np.arange(len(own)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    earlier = least[np.repeat(begins[own], n) + offset] < ids[member]
    member, offset = member[earlier], offset[earlier]
    new = np.ones(len(member), bool)
    new[1:] = (member[1:] != member[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(member))[1:] - 1
    at = places[member[first], 2] + offset[first]
    return np.column_stack((places[member[first], 1], at, at + offset[last] - offset[first] + WINDOW)).astype(np.int32)


def _look_up(streams: pa.Table, owners: pa.Table | None = None) -> pa.Table:
    """The intervals of the streams, by an index of all of the shard's, or by what was found for the different runs of this group."""
    if not streams.num_rows:
        return _binary_table(_FOUND, [])
    own = Text()
    numbers = [own.add_places(runs, keys, places[:, 0], ids) for runs, keys, places, ids in _streams(streams)]
    if owners is None:
        found_by, begins = own.owners()
    else:
        sizes = np.fromiter((r.count(b" ") for r in own.known), np.int64, len(own.known)) + 2 - WINDOW
        found_by, begins = _unpacked(owners.column("owners")[0].as_py(), np.int64), np.append(0, np.cumsum(sizes))
    found = (_intervals(found_by, begins, number, places, ids) for number, (_, _, places, ids) in zip(numbers, _streams(streams)))
    return _binary_table(_FOUND, [(n, x.tobytes()) for n, x in zip(streams.column("block").to_pylist(), found) if len(x)])


def _remove(kept: Sequence[str], outputs: Sequence[str], schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        ids, texts = left.column("__id").to_numpy(zero_copy_only=False), [t or "" for t in left.column("__text").to_pylist()]
        order = in_order(ids, texts)
        data = [texts[i].encode().split() for i in order]
        first = np.append(0, np.cumsum([len(d) for d in data]))
        gone = np.zeros(first[-1] + 1, np.int64)  # steps of how many intervals cover a word
        for packed in right.column("intervals").to_pylist():
            doc, a, b = np.frombuffer(packed, np.int32).reshape(-1, 3).T.astype(np.int64)
            np.add.at(gone, first[doc] + a, 1)
            np.add.at(gone, first[doc] + b, -1)
        stays = np.cumsum(gone)[:-1] == 0
        rows: dict[str, list] = {name: [] for name in outputs}
        for words, a, b in zip(data, first.tolist(), first[1:].tolist()):
            own = stays[a:b]
            text = b" ".join(words if own.all() else [w for w, ok in zip(words, own.tolist()) if ok])
            if "n_words" in rows:
                rows["n_words"].append(b - a)
            if "n_removed" in rows:
                rows["n_removed"].append(int(b - a - own.sum()))
            if "kept_sha256" in rows:
                rows["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            if "kept_text" in rows:
                rows["kept_text"].append(text.decode())
            if "removed_spans" in rows:
                edge = np.flatnonzero(np.diff(np.concatenate(([1], own, [1])).astype(np.int8)))
                rows["removed_spans"].append(edge.reshape(-1, 2).tolist())
        ordered = left.select(list(kept)).take(pa.array(order))
        columns = [*(c.combine_chunks() for c in ordered.columns), *(pa.array(rows[n], _ARROW[n]) for n in outputs)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _found(runs: DataFrame, groups: int) -> DataFrame:
    """The intervals of all blocks (block, intervals)."""
    if groups == 1:
        return runs.groupBy("shard").applyInArrow(lambda streams: _look_up(streams), _FOUND_DDL)
    dealt = runs.withColumn("part", F.col("block") % groups)
    texts = dealt.groupBy("shard", "part").applyInArrow(_text_of_streams, _TEXT_DDL)
    owners = texts.groupBy("shard").applyInArrow(_owners_of_texts, _OWNERS_DDL)
    return dealt.groupBy("shard", "part").cogroup(owners.groupBy("shard", "part")).applyInArrow(lambda streams, found: _look_up(streams, found), _FOUND_DDL)


def remove_repeats(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    outputs: Sequence[str] = ("n_words", "n_removed", "kept_text"),
    keep: Sequence[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    common: int = COMMON,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``df`` with what is left of ``text`` when windows that an earlier document has are removed; ``outputs`` are names in ``OUTPUTS``.

    An anchor of more than ``common`` different windows, summed over blocks, is dealt by window. ``removed_spans`` has pairs of word numbers, the second one past the end. Columns named as outputs give way to them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in {o.lower() for o in outputs}]
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    shards, index_shards = max(1, blocks // BLOCKS_A_SHARD), max(1, blocks // BLOCKS_AN_INDEX)
    number = F.coalesce(F.col(key).cast("long"), F.lit(int(NO_ID)))
    names = [f"__kept_{i}" for i in range(len(kept))]
    # Dealt by the text as well: rows without a doc_id, or with one, may be many.
    block = F.pmod(F.xxhash64(number, F.col(text), F.lit(3)), F.lit(blocks)).cast("int")
    dealt = on_workers(df).select(block.alias("block"), number.alias("__id"), F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    anchors = dealt.groupBy("block").applyInArrow(_send_anchors(shards), _ANCHORS_DDL)
    answers = anchors.groupBy("shard").applyInArrow(_answer_anchors(common), _ANSWERS_DDL)
    runs = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_runs(shards, index_shards), _RUNS_DDL)
    found = _found(runs, -(-blocks // fan_in))
    fields = [dealt.schema[n] for n in names] + [T.StructField(o, OUTPUTS[o], False) for o in outputs]
    schema = T.StructType(fields)
    cleaned = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_remove(names, outputs, to_arrow_schema(schema)), schema)
    return cleaned.toDF(*kept, *outputs)
