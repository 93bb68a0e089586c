import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from strideframe.llm import bpe, merging, pretokens, token_counts
from tokenizers import Tokenizer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "'’sStTrevdlm  \n\t\r 　 19²½éßяжあ漢\U0001f600!?-_#\x00\x1c\x85"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoding_matches_the_library(library):
    texts = _random_texts(5000) + ["a" * 5000, "ab " * 300, "é" * 300, "thethethe" * 50, "we're I'll o''s 's", "", "   "]
    cache = bpe.pieces_cache(RANKS)
    found = [x.tolist() for x in bpe.encode_texts(cache, texts)]
    assert found == [library.encode_ordinary(t) for t in texts]
    merger = merging.rank_merger(RANKS)
    assert all(bpe.decode_ids(merger, ids) == t.encode() for ids, t in zip(found, texts))
    for ids, t in zip(found, texts):
        numbers = np.array(ids, np.int32)
        offsets = bpe.token_offsets(merger, numbers)
        assert bpe.decode_at(merger, numbers, offsets) == t.encode()
        assert all(t.encode()[a:b] == merger.table[i] for i, a, b in zip(ids, offsets.tolist(), offsets.tolist()[1:]))


def test_every_code_point_is_split_as_the_library_does(library):
    cache = bpe.pieces_cache(RANKS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for before, after in (("a", "a"), ("1", "1"), ("-", "-")):
        for i in range(0, len(points), 5000):
            text = " ".join(before + chr(c) + after for c in points[i : i + 5000])
            assert bpe.encode_texts(cache, [text])[0].tolist() == library.encode_ordinary(text), (before, i)


def test_scan_states_are_few():
    assert pretokens._tables()[3].shape[0] < 50


def test_counts_match_the_library():
    library = Tokenizer.from_file(JSON)
    texts = [t + "<|endoftext|>" * (i % 3) + t[::-1] for i, t in enumerate(_random_texts(3000, 2))]
    count = token_counts.counter(JSON, token_counts.proof(JSON))
    assert count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(len(x) == 1 for x in count.merger.merge(list(count.whole))) and len(count.whole) > 40_000


def test_queries_take_odd_rows(odd, library):
    rows = bpe.encode(odd, RANKS, outputs=("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    counted = token_counts.count_tokens(odd, JSON, limit=3).collect()
    tk = Tokenizer.from_file(JSON)
    assert all(r.n_tokens == len(tk.encode(r.text or "", add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 3) for r in counted)
    assert bpe.encode(odd.limit(0), RANKS).count() == 0


def test_decode_is_the_inverse(odd):
    from pyspark.sql import functions as F

    encoded = bpe.encode(odd, RANKS, outputs=("token_ids",), keep=["doc_id", "text"])
    back = bpe.decode(encoded, RANKS)
    assert back.where(F.encode(F.coalesce("text", F.lit("")), "UTF-8") != F.col("decoded")).count() == 0
