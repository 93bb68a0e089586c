"""Words of many texts at once as arrays: places and 64-bit hashes, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: An odd base of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return np.cumprod(np.full(n, BASE, np.uint64)), np.cumprod(np.full(n, INVERSE, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordTable:
    """``data`` holds the texts' UTF-8 bytes, each followed by a line end; a word is a run of bytes other than ASCII white space."""

    def __init__(self, texts: Sequence[str], lower: bool = False) -> None:
        encoded = [t.encode() for t in texts]
        self.data = b"\n".join(encoded) + b"\n" if encoded else b""
        a = np.frombuffer(self.data, np.uint8)
        if lower:
            a = _LOWER[a]
        self.bytes = a
        edge = np.flatnonzero(np.diff(_BLANK[a].view(np.int8), prepend=1, append=1))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.text_ends = np.cumsum(sizes) - 1
        #: Each text's first word, with the number of words last.
        self.first = np.searchsorted(self.starts, np.concatenate(([0], self.text_ends)))
        up, down = _powers(max(20, len(a).bit_length()))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])))
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts]) if len(self.starts) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]
