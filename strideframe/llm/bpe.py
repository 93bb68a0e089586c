"""Operator 2: byte-level BPE encoding and decoding.

Texts are split by class arrays and an associative scan (``pretokens``), the
slices are merged through a bounded cache (``merging``), and ids keep the byte
offset at which each token starts. Decoding puts each token's bytes at its offset, and
a span of ids decodes to its span of text.

Defined cases: a null text is an empty one; an empty text has no ids, and its
digests are those of no bytes; very long texts are encoded whole, in slices; repeated
rows are encoded each; an empty table gives an empty result; a kept column with the name
of a new one gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_arrow, chunks
from .merging import Cache, Merger, rank_merger
from .pretokens import split_batch

#: Code points that are split at a time.
CHUNK = 1_000_000

FIELDS = {
    "token_ids": T.ArrayType(T.IntegerType(), False),
    "token_offsets": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


@lru_cache(4)
def pieces_cache(vocabulary: str) -> Cache:
    """Pre-tokens' ids as packed 32-bit numbers; whole tokens are there from the start."""
    merger = rank_merger(vocabulary)
    whole = {k: np.int32(v).tobytes() for k, v in merger.tokens.items()}
    return Cache(whole, lambda pieces: [ids.tobytes() for ids in merger.merge(pieces)])


def encode_texts(cache: Cache, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text."""
    data, starts, ends, first = split_batch(texts)
    found = cache([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    bounds = first.tolist()
    return [np.frombuffer(b"".join(found[a:b]), np.int32) for a, b in zip(bounds, bounds[1:])]


def decode_ids(merger: Merger, ids: Sequence[int]) -> bytes:
    """The bytes of these ids."""
    return b"".join(map(merger.table.__getitem__, ids))


def token_offsets(merger: Merger, ids: np.ndarray) -> np.ndarray:
    """The byte at which each token starts, with the number of bytes last."""
    return np.concatenate(([0], np.cumsum(merger.sizes[ids])))


def decode_at(merger: Merger, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """The bytes of these ids, each token's put where it starts."""
    where = np.repeat(merger.places[ids] - offsets[:-1], np.diff(offsets))
    return merger.bytes[where + np.arange(offsets[-1])].tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of these arrays, without a Python object for each number."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", outputs: Sequence[str] = ("token_ids", "token_offsets"), keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the tokens of ``text`` by the rank file ``vocabulary``; ``outputs`` are names in ``FIELDS``."""
    wanted = set(outputs)

    def make():
        merger, cache = rank_merger(vocabulary), pieces_cache(vocabulary)
        names = [str(i) for i in range(len(merger.table))]

        def run(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            made: dict[str, list] = {k: [] for k in outputs}
            for a, b in chunks([len(t) for t in texts], CHUNK):
                for ids in encode_texts(cache, texts[a:b]):
                    offsets = token_offsets(merger, ids)
                    if "token_ids" in wanted:
                        made["token_ids"].append(ids)
                    if "token_offsets" in wanted:
                        made["token_offsets"].append(offsets[:-1].astype(np.int32))
                    if "n_tokens" in wanted:
                        made["n_tokens"].append(len(ids))
                    if "ids_sha256" in wanted:
                        made["ids_sha256"].append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    if "decoded_sha256" in wanted:
                        made["decoded_sha256"].append(hashlib.sha256(decode_at(merger, ids, offsets)).hexdigest())
            lists = {"token_ids", "token_offsets"}
            return [_lists(made[k]) if k in lists else pa.array(made[k], pa.int64() if k == "n_tokens" else pa.string()) for k in outputs]

        return run

    return append_arrow(df, [text], [T.StructField(k, FIELDS[k], False) for k in outputs], make, keep)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", output: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the bytes of its ids; null ids give null."""

    def make():
        merger = rank_merger(vocabulary)

        def run(column: pa.Array) -> list[pa.Array]:
            return [pa.array([None if x is None else decode_ids(merger, x) for x in column.to_pylist()], pa.binary())]

        return run

    return append_arrow(df, [ids], [T.StructField(output, T.BinaryType())], make, keep)
