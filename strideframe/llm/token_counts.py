"""Operator 5: token counts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by the driver and
before any text is read, by merging each; tasks get the proof as a bit for each string. A pre-token in the proved set counts as one token; only the
rest are merged. Special strings inside a text are cut out first and count as one
token each, as the library does by default.

Defined cases: a null text is an empty one, with no tokens; very long texts are counted
whole; repeated rows are counted each; an empty table gives an empty result; a kept column
with the name of a new one gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, chunks
from .merging import Cache, json_merger
from .pretokens import split_batch

CHUNK = 1_000_000


@lru_cache(4)
def proof(path: str) -> bytes:
    """A bit for each string of the vocabulary: whether it is one token when it stands alone."""
    merger = json_merger(path)[0]
    return np.packbits([len(ids) == 1 for ids in merger.merge(list(merger.tokens))]).tobytes()


class Counter:
    """Counts the tokens of texts; ``proved`` is the vocabulary's ``proof``."""

    def __init__(self, path: str, proved: bytes) -> None:
        self.merger, special = json_merger(path)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        whole = np.unpackbits(np.frombuffer(proved, np.uint8), count=len(self.merger.tokens))
        self.whole = {t: 1 for t, one in zip(self.merger.tokens, whole.tolist()) if one}
        self.counts = Cache(self.whole, lambda pieces: [len(ids) for ids in self.merger.merge(pieces)])

    def __call__(self, texts: list[str]) -> list[int]:
        parts, owners, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            found = self.special.split(t) if self.special and self.special.search(t) else [t]
            extra[i] = len(found) - 1
            parts += found
            owners += [i] * len(found)
        data, starts, ends, first = split_batch(parts)
        each = np.array(self.counts([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), np.int64)
        totals = np.concatenate(([0], np.cumsum(each)))[first]
        out = np.array(extra, np.int64)
        np.add.at(out, np.array(owners, np.intp), np.diff(totals))
        return out.tolist()


@lru_cache(4)
def counter(path: str, proved: bytes) -> Counter:
    return Counter(path, proved)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (more tokens than ``limit``)."""

    proved = proof(vocabulary)

    def make():
        count = counter(vocabulary, proved)

        def run(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            made: list[int] = []
            for a, b in chunks([len(t) for t in texts], CHUNK):
                made += count(texts[a:b])
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(made, pa.int64())]

        return run

    fields = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)]
    out = append_arrow(df, [text], fields, make, keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
