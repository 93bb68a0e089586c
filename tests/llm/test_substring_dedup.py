import hashlib
import random

import numpy as np
from strideframe.llm import substring_dedup
from strideframe.llm.fm_index import Bits, FmIndex, WaveletMatrix


def brute(rows, n=13):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, w in words:
        for k in range(len(w) - n + 1):
            q = tuple(w[k : k + n])
            first[q] = min(first.get(q, key(i)), key(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < key(i):
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _corpus(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 40))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        rows.append((i * 7 % 120, " \n".join(text)))
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, "so so " * 300), (301, "so so " * 20), (5, "a repeated row"), (5, "a repeated row"), (None, rows[3][1]), (400, None), (401, "")]
    return rows


def test_against_brute_force(documents):
    rows = _corpus(random.Random(3))
    for block_bytes, fan_in in ((600, 5), (2000, 4096), (1 << 20, 4096)):
        found = substring_dedup.remove_repeats(documents(rows), outputs=("n_words", "n_removed", "kept_sha256"), keep=["doc_id"], block_bytes=block_bytes, fan_in=fan_in)
        assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_common_anchors_are_dealt_by_window(documents):
    rng = random.Random(5)
    phrase = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(15))} {phrase} {' '.join(f'v{rng.randint(0, 3)}' for _ in range(9))}") for i in range(300)]
    found = substring_dedup.remove_repeats(documents(rows), outputs=("n_words", "n_removed", "kept_sha256"), keep=["doc_id"], block_bytes=1000, common=50)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_odd_rows_and_spans(odd):
    rows = substring_dedup.remove_repeats(odd, outputs=("n_words", "n_removed", "removed_spans", "kept_text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        words = (r.text or "").encode().split()
        assert r.n_words == len(words) and r.n_removed == sum(b - a for a, b in r.removed_spans)
        gone = {i for a, b in r.removed_spans for i in range(a, b)}
        assert r.kept_text.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert substring_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 23, 700)
    wavelet = WaveletMatrix(seq, 23)
    at, symbols = rng.integers(0, 701, 500), rng.integers(0, 23, 500)
    assert wavelet.rank(symbols, at).tolist() == [int((seq[:i] == s).sum()) for s, i in zip(symbols, at)]


def test_neighbours_of_set_bits():
    rng = np.random.default_rng(2)
    for size, share in ((1000, 0.03), (64, 0), (65, 0), (1, 0), (128, 0.5)):
        flags = rng.random(size) < share
        flags[0] = True
        bits, at = Bits(flags).with_neighbours(), np.arange(size)
        assert bits.at_or_before(at).tolist() == [max(j for j in range(i + 1) if flags[j]) for i in range(size)]
        assert bits.after(at).tolist() == [min((j for j in range(i + 1, size) if flags[j]), default=size) for i in range(size)]


def test_matching_statistics_against_brute_force():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        depth, k = int(rng.integers(1, 8)), int(rng.integers(2, 6))
        pieces = [rng.integers(1, k + 1, int(rng.integers(1, 40))) for _ in range(int(rng.integers(1, 20)))]
        owners = rng.integers(0, 100, len(pieces))
        index = FmIndex(np.concatenate([np.append(p, 0) for p in pieces]), k + 1, depth, np.repeat(owners, [len(p) + 1 for p in pieces]))
        streams = [rng.integers(1, k + 1, int(rng.integers(1, 30))) for _ in range(12)]
        for x in streams:
            x[rng.random(len(x)) < 0.05] = -1
        sizes = np.array([len(x) for x in streams])
        length, group = index.matching(np.concatenate(streams), np.cumsum(sizes) - sizes, sizes)
        at = 0
        for x in streams:
            for i in range(len(x)):
                has = lambda n: [o for o, p in zip(owners, pieces) if any((p[j : j + n] == x[i : i + n]).all() for j in range(len(p) - n + 1))]  # noqa: B023, E731
                best = max((n for n in range(1, min(depth, len(x) - i) + 1) if has(n)), default=0)
                assert length[at] == best
                assert index.least[group[at]] == min(has(depth)) if best == depth else group[at] == -1
                at += 1


def _shard(rows, rng):
    """A shard of all runs of 13 to 40 words of ``rows``, each run under the same anchor as any that shares a window with it."""
    runs = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for a in range(0, len(words) - 12, rng.randint(1, 9)):
            runs.setdefault(b" ".join(words[a : a + rng.randint(13, 40)]), set()).add(i)
    texts = list(runs)
    ids = [runs[t] for t in texts]
    return substring_dedup.Shard(texts, np.zeros(len(texts), np.uint32), np.array([min(i) for i in ids]), np.array([max(i) for i in ids])), texts, ids


def test_a_shard_streams_what_it_has_not_indexed():
    rng = random.Random(9)
    rows = [(i, t) for i, t in _corpus(rng) if i is not None and i < 200]
    shard, texts, ids = _shard(rows, rng)
    asked = []
    made = shard.index
    shard.index = lambda starts, sizes, owners: (asked.append(set(owners.tolist())), made(starts, sizes, owners))[1]
    owners = shard.owners()
    earliest = {}
    for t, own in zip(texts, ids):
        w = t.split()
        for k in range(len(w) - 12):
            q = tuple(w[k : k + 13])
            earliest[q] = min(earliest.get(q, 1 << 40), min(own))
    at = 0
    for t, own in zip(texts, ids):
        w = t.split()
        for k in range(len(w) - 12):
            for i in own:  # what decides for each document that has the run
                assert (owners[at] < i) == (earliest[tuple(w[k : k + 13])] < i)
            at += 1
    assert len(owners) == at and len(asked) > 1 and len(asked[0]) == 1  # the first index holds one document
    assert shard.streamed > 0 and shard.broken > 0.05 * shard.streamed


def test_many_groups_send_each_text_once(spark, documents):
    """What goes to a shard's index is no more than the runs themselves, however many groups there are, and nothing is sent to all of them."""
    rows = _corpus(random.Random(4))
    sizes = {}
    for fan_in in (3, 12):
        seen = []
        found = substring_dedup._found
        try:
            substring_dedup._found = lambda runs, groups: (seen.append((runs, groups)), found(runs, groups))[1]
            plan = substring_dedup.remove_repeats(documents(rows), block_bytes=300, fan_in=fan_in)._jdf.queryExecution().executedPlan().toString()
        finally:
            substring_dedup._found = found
        assert "Generate" not in plan and "Broadcast" not in plan
        runs, groups = seen[0]
        texts = runs.selectExpr("*", f"block % {groups} AS part").groupBy("shard", "part").applyInArrow(substring_dedup._text_of_streams, substring_dedup._TEXT_DDL)
        n_runs = sum(len(substring_dedup._unpacked_runs(bytes(r.runs))) for r in runs.collect())
        n_texts = sum(len(substring_dedup._unpacked_runs(bytes(r.runs))) for r in texts.collect())
        sizes[groups] = n_texts / n_runs
    assert len(sizes) == 2 and max(sizes.values()) <= 1
