"""A compressed FM-index over words, and the matching statistics of streams against it.

The Burrows-Wheeler transform lies in a wavelet matrix, which is packed bits. For each
length up to a depth packed bits mark the rows whose suffix shares fewer words than that
with the row before, and a byte for each row says how many words these share. They take
the place of the suffix array, which the index doesn't keep.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with ranks and neighbours of set bits, many at a time."""

    def __init__(self, flags: np.ndarray) -> None:
        n_words = len(flags) // 64 + 1
        self.packed = np.zeros(n_words, np.uint64)
        raw = np.packbits(flags, bitorder="little")
        self.packed.view(np.uint8)[: len(raw)] = raw
        self.before = np.zeros(n_words, np.uint32)
        np.cumsum(np.bitwise_count(self.packed[:-1]), out=self.before[1:], dtype=np.uint32)
        self.size = len(flags)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.packed[word] & below)

    def with_neighbours(self) -> Bits:
        """Also notes, for each packed word, the nearest one before (after) it that has a bit."""
        some, at = self.packed != 0, np.arange(len(self.packed), dtype=np.int32)
        self.last = np.maximum.accumulate(np.where(some, at, -1)).astype(np.int32)
        self.next = np.minimum.accumulate(np.where(some, at, len(at))[::-1])[::-1].astype(np.int32)
        return self

    def at_or_before(self, at: np.ndarray) -> np.ndarray:
        """The last set bit up to each place; the first bit is set."""
        word = at >> 6
        held = self.packed[word] & (~np.uint64(0) >> (np.uint64(63) - (at & 63).astype(np.uint64)))
        away = held == 0
        word = np.where(away, self.last[np.maximum(word - 1, 0)], word)
        held = np.where(away, self.packed[word], held)
        for k in (1, 2, 4, 8, 16, 32):
            held |= held >> np.uint64(k)
        return (word.astype(np.int64) << 6) + np.bitwise_count(held) - 1

    def after(self, at: np.ndarray) -> np.ndarray:
        """The first set bit after each place, or the size."""
        place = at + 1
        word = place >> 6
        held = self.packed[np.minimum(word, len(self.packed) - 1)] & (~np.uint64(0) << (place & 63).astype(np.uint64))
        away = held == 0
        word = np.where(away, self.next[np.minimum(word + 1, len(self.next) - 1)], word)
        none = away & ((word >= len(self.packed)) | ((place >> 6) + 1 >= len(self.packed)))
        held = np.where(away, self.packed[np.minimum(word, len(self.packed) - 1)], held)
        low = np.bitwise_count((held & (~held + _ONE)) - _ONE)
        return np.where(none, self.size, (word.astype(np.int64) << 6) + low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = []
        seq = sequence.astype(np.int32)
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(seq) - int(ones.sum())))
            seq = np.concatenate((seq[~ones], seq[ones]))
        self.origin = self._place(np.arange(symbols), np.zeros(symbols, np.int64))

    def _place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._place(symbols, at) - self.origin[symbols]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _later(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[: len(a) - k] = a[k:] + 1
    return out


class FmIndex:
    """Over ``words``, numbers from 1 with 0 after each piece; ``owner`` is a number for each of them.

    ``least`` has, for each group of rows that share ``depth`` words, the least owner of
    their first words.
    """

    def __init__(self, words: np.ndarray, symbols: int, depth: int, owner: np.ndarray) -> None:
        self.depth, self.symbols, self.size = depth, symbols, len(words)
        ranks, length = words.astype(np.int64), 1
        while length < depth:
            ranks = _pair(ranks, _later(ranks, length)) if length < len(ranks) else ranks
            length *= 2
        rows = np.argsort(ranks, kind="stable")
        self.wavelet = WaveletMatrix(words[rows - 1], symbols)  # before the first word comes the last
        counts = np.bincount(words, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        padded = np.concatenate((words, np.zeros(depth, words.dtype)))
        same, self.marks = np.ones(max(len(rows) - 1, 0), bool), []
        #: Words that a row shares with the one before, up to the depth; none beyond the ends.
        self.common = np.zeros(len(rows) + 1, np.uint8)
        for k in range(depth):
            here = padded[rows + k]
            same &= here[1:] == here[:-1]
            self.common[1 : len(rows)] += same
            self.marks.append(Bits(np.concatenate((np.ones(min(1, len(rows)), bool), ~same))).with_neighbours())
        self.least = np.minimum.reduceat(owner[rows], np.flatnonzero(np.concatenate(([True], ~same)))) if len(rows) else owner

    def step(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each interval with a word put before its match."""
        n = len(words)
        both = self.wavelet.rank(np.concatenate((words, words)), np.concatenate((low, high)))
        return self.first[words] + both[:n], self.first[words] + both[n:]

    def widened(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all rows that share the first ``length`` words of the row ``low``."""
        a, b = np.zeros(len(low), np.int64), np.full(len(low), self.size, np.int64)
        for k in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == k)
            a[own], b[own] = self.marks[k - 1].at_or_before(low[own]), self.marks[k - 1].after(low[own])
        return a, b

    def matching(self, stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of pieces of a stream of words (unknown ones are negative).

        For each place the length of the longest match that begins there, up to the
        depth, and the group in ``least`` of those of full depth, or -1. All pieces are
        read from their ends at once. A match that can't take the next word drops its
        last ones, up to the next length at which other rows share it, and so on.
        """
        found_length, found_group = np.zeros(len(stream), np.uint8), np.full(len(stream), -1, np.int64)
        if not self.size:
            return found_length, found_group
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64), np.zeros(len(sizes), np.int64)
        for back in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -back, "left"))  # those longer than ``back``
            at = starts[:live] + sizes[:live] - 1 - back
            word = stream[at]
            lo, hi, ln = low[:live], high[:live], length[:live]
            ln[word < 0] = 0
            full = np.flatnonzero((ln == self.depth) & (word >= 0))
            ln[full] -= 1
            lo[full], hi[full] = self.widened(lo[full], ln[full])
            todo = np.flatnonzero(word >= 0)
            while len(todo):
                a, b = self.step(word[todo], lo[todo], hi[todo])
                good = a < b
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                ln[done] += 1
                todo = todo[~good]
                ended = todo[ln[todo] == 0]  # the word is nowhere
                todo = todo[ln[todo] > 0]
                word[ended] = -1
                ln[todo] = np.maximum(self.common[lo[todo]], self.common[hi[todo]])
                lo[todo], hi[todo] = self.widened(lo[todo], ln[todo])
            lost = word < 0
            lo[lost], hi[lost] = 0, self.size
            found_length[at] = ln
            whole = np.flatnonzero(ln == self.depth)
            found_group[at[whole]] = self.marks[-1].rank(lo[whole] + 1) - 1
        return found_length, found_group
