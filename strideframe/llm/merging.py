"""Byte-pair merging by a table of adjacent pairs, with a bounded cache of pre-tokens."""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np

NONE = 1 << 60
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
#: Pre-tokens above this length use a heap, as the plain search is quadratic.
LONG = 200
#: Pre-tokens that are merged side by side.
BATCH = 20_000
CACHE_ENTRIES = 150_000
CACHE_BYTES = 64


class PairTable:
    """Adjacent pairs in open addressing, looked up many at a time."""

    def __init__(self, pairs: dict[int, int]) -> None:
        bits = max(10, (len(pairs) * 4).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NONE, np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # of those that want one slot the first gets it, the others go on
            at = slots[left]
            free = np.flatnonzero(self.keys[at] == -1)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            left = np.delete(left, won)
            slots[left] = (slots[left] + 1) % self.size

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << ID_BITS | right
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % self.size
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Merger:
    """Merges a pre-token's bytes: the pair of lowest rank first, the leftmost among equals."""

    def __init__(self, tokens: dict[bytes, int], pairs: dict[int, int]) -> None:
        self.tokens = tokens
        self.pairs = pairs  # left id << ID_BITS | right id -> rank << ID_BITS | merged id
        self.lookup = PairTable(pairs)
        self.of_byte = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        self.table: list[bytes] = [b""] * (max(tokens.values()) + 1)
        for k, v in tokens.items():
            self.table[v] = k
        #: All tokens' bytes one after another, and each one's size and place there.
        self.bytes = np.frombuffer(b"".join(self.table), np.uint8)
        self.sizes = np.fromiter(map(len, self.table), np.int64, len(self.table))
        self.places = np.cumsum(self.sizes) - self.sizes

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token; they are merged side by side with others of like length."""
        out: list = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order) and sizes[order[at]] <= LONG:
            most = max(8, int(sizes[order[at]]) * 5 // 4)
            to = int(np.searchsorted(sizes[order], min(most, LONG), "right"))
            to = min(to, at + BATCH)
            rows = order[at:to]
            for i, ids in zip(rows.tolist(), self._merge_rows([pieces[i] for i in rows])):
                out[i] = ids
            at = to
        for i in order[at:].tolist():
            out[i] = self._merge_long(self.of_byte[np.frombuffer(pieces[i], np.uint8)].tolist())
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width, n = int(sizes.max()), len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids, columns = self.of_byte[raw], np.arange(width)
        ranks = np.full((n, width), NONE, np.int64)  # of the pair that begins here
        if width > 1:
            valid = columns[1:] < sizes[:, None]
            ranks[:, :-1][valid] = self.lookup(ids[:, :-1][valid], ids[:, 1:][valid])
        live, done = np.arange(n), [None] * n
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            over = best == NONE
            if over.any():
                for i, row, size in zip(live[over].tolist(), ids[over], sizes[over].tolist()):
                    done[i] = row[:size].astype(np.int32)
                go = ~over
                live, ids, ranks, sizes, at, best = live[go], ids[go], ranks[go], sizes[go], at[go], best[go]
            if not len(live):
                return done
            rows, width = np.arange(len(live)), int(sizes.max())
            if width < ids.shape[1]:
                ids, ranks = ids[:, :width], ranks[:, :width]
            # The right one of each pair goes; what follows it moves up.
            shift = np.arange(width - 1) > at[:, None]
            ids = np.concatenate((np.where(shift, ids[:, 1:], ids[:, :-1]), ids[:, -1:]), 1)
            moved = np.where(np.arange(width - 1) >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks = np.concatenate((moved, np.full((len(live), 1), NONE, np.int64)), 1)
            sizes = sizes - 1
            merged = best & ID_MASK
            ids[rows, at] = merged
            ranks[rows, at] = NONE
            has = np.flatnonzero(at + 1 < sizes)
            if len(has):
                ranks[has, at[has]] = self.lookup(merged[has], ids[has, at[has] + 1])
            has = np.flatnonzero(at > 0)
            if len(has):
                ranks[has, at[has] - 1] = self.lookup(ids[has, at[has] - 1], merged[has])

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        n, get = len(ids), self.pairs.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r >> ID_BITS, i, i + 1, a, b, r) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get(a << ID_BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b, value = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or right[i] != j or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = value & ID_MASK, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := get(ids[p] << ID_BITS | ids[q])) is not None:
                    heapq.heappush(heap, (r >> ID_BITS, p, q, ids[p], ids[q], r))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)


class Cache:
    """What has been made of pre-tokens. Entries in ``fixed`` stay; when full, the others go."""

    def __init__(self, fixed: dict[bytes, object], make) -> None:
        self.fixed, self.known, self.make = fixed, dict(fixed), make

    def __call__(self, pieces: list[bytes]) -> list:
        found = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            fresh = list({pieces[i] for i in missing})
            made = dict(zip(fresh, self.make(fresh)))
            for i in missing:
                found[i] = made[pieces[i]]
            if len(self.known) > len(self.fixed) + CACHE_ENTRIES:
                self.known = dict(self.fixed)
            self.known.update((k, v) for k, v in made.items() if len(k) <= CACHE_BYTES)
        return found


@lru_cache(4)
def rank_merger(path: str) -> Merger:
    """From a rank file: any two tokens whose bytes together are a token may merge, at its rank.

    The library takes a pre-token that is itself in the file whole, so those enter the cache first.
    """
    with open(path, "rb") as f:
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = {}
    for token, rank in tokens.items():
        for i in range(1, len(token)):
            a, b = tokens.get(token[:i]), tokens.get(token[i:])
            if a is not None and b is not None:
                pairs[a << ID_BITS | b] = rank << ID_BITS | rank
    return Merger(tokens, pairs)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary's JSON file.

    Printable Latin-1 bytes stand for themselves; the others take the letters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(4)
def json_merger(path: str) -> tuple[Merger, tuple[str, ...]]:
    """From a byte-level tokenizer's JSON file: the merger and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_letters()
    raw = lambda s: bytes(of[c] for c in s)
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    tokens = {raw(s): i for s, i in vocab.items() if s not in special}
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        pairs.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
    return Merger(tokens, pairs), tuple(sorted(special, key=len, reverse=True))
