import hashlib
import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from strideframe.llm.quality import base_failed, base_features

from .test_bpe import library  # noqa: F401
from .test_classifiers import labelled, plain_base, plain_quality, prose
from .test_mixing import plain_taken
from .test_simhash import fingerprint, least_reachable


def test_stages_work_on_what_is_left(spark, documents, tmp_path):
    rng = random.Random(5)
    shared = prose(60)
    rows = []
    for i in range(120):
        text = f"{prose(70)}\n{shared}\n{prose(70)}" if i % 4 == 0 else prose(150)
        if i % 10 == 9:
            text = "%%% ".join(text.split(" "))
        rows.append((i, text, f"s{rng.randint(0, 3)}"))
    rows += [(500 + i, rows[1][1], "s1") for i in range(5)] + [(600, None), (601, "too short")]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 9), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mix", "tokens"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, str(tmp_path))
        if name != "tokens":
            assert seen.columns == docs.columns
        seen.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r.doc_id for r in seen.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {i for i in range(120) if i % 10 != 9} | {500, 501, 502, 503, 504}
        if name == "near_duplicates":
            assert not ids & {500, 501, 502, 503, 504} and 1 in ids
        if name == "repeated_passages":
            assert seen.where(F.contains("text", F.lit(shared[10:]))).count() == 1
            assert seen.count() == before.count()
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(again) == key(seen)


def plain_removal(rows, n=13):
    """Texts less the windows that an earlier document has; words of changed ones parted by one space."""
    first, words = {}, {i: t.split() for i, t in rows.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for p in range(k, k + n)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else rows[i]
    return out


def test_the_whole_pipeline_against_plain_forms(spark, documents, library, tmp_path):  # noqa: F811
    rng = random.Random(8)
    shared, rows = [prose(40) for _ in range(4)], []
    for i in range(160):
        text = " \n".join([prose(rng.randint(10, 70)), rng.choice(shared) if i % 3 == 0 else prose(20), prose(rng.randint(1, 60))])
        rows.append((i, "%% || " + text if i % 11 == 0 else text, rng.choice(["a", "b", "b", "c", None])))
    for i in range(40):  # copies and slight edits
        words = rows[rng.randrange(160)][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((1000 + i, " ".join(words), "b"))
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, "so so so " * 40, "a"), (2003, prose(49), "c")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    # With labels of one kind there is no threshold, and the base rules alone decide.
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    def passes(text):
        n_words, *_, repeated = plain_base(text or "")
        return n_words >= 50 and 100 * repeated <= 50 * n_words

    left = {i: (t, s) for i, t, s in rows if passes(t)}
    prints = {i: fingerprint(t) for i, (t, _) in left.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    left = {i: left[i] for i, least in least_reachable(near, prints).items() if i == least}
    assert 100 < len(left) < 185 and 2003 not in left
    texts = plain_removal({i: t for i, (t, _) in left.items()})
    assert sum(len(texts[i]) < len(t) for i, (t, _) in left.items()) > 20
    want = []
    for (i, n, _), (taken,) in plain_taken(documents([(i, texts[i], s) for i, (_, s) in left.items()])).items():
        words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", texts[i])
        parts = [texts[i]] * (taken // n) + (["".join(words[: taken % n])] if taken % n else [])
        for part in parts:
            ids = library.encode_ordinary(part)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert found == sorted(want)


def test_quality_stage_keeps_what_all_labels_say(spark, documents, tmp_path):
    texts, quality_of = labelled()
    spark.createDataFrame(list(enumerate(quality_of)), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    failed = np.array([base_failed(f[0], f[4]) for f in map(base_features, texts)])
    _, kept = plain_quality(spark, texts, quality_of, failed)
    found = corpus_pipeline.quality_rules(spark, documents(list(enumerate(texts))), str(tmp_path)).select("doc_id").collect()
    assert sorted(r.doc_id for r in found) == np.flatnonzero(kept).tolist() and 0 < kept.sum() < len(texts)


def test_quality_stage_takes_all_labels_whatever_the_type_of_their_keys(spark, documents, tmp_path):
    """xxhash64 of equal keys differs by type; labels were lost where theirs and their text's fell apart."""
    texts, quality_of = labelled(3000)
    failed = np.array([base_failed(f[0], f[4]) for f in map(base_features, texts)])
    _, kept = plain_quality(spark, texts, quality_of, failed)
    labels = spark.createDataFrame(list(enumerate(quality_of)), "doc_id long, quality int")
    for kind in ("long", "int", "string"):
        labels.select(F.col("doc_id").cast(kind), "quality").write.parquet(f"{tmp_path}/{kind}/labels.parquet")
        found = corpus_pipeline.quality_rules(spark, documents(list(enumerate(texts))), f"{tmp_path}/{kind}").select("doc_id").collect()
        assert sorted(r.doc_id for r in found) == np.flatnonzero(kept).tolist(), kind


def test_stages_take_odd_rows(spark, odd, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = documents([(i, prose(80)) for i in range(20, 24)] + [(None, prose(80)), (None, None), (20, prose(90))])
    more = long.select("*", *[F.lit("own").alias(c) for c in odd.columns if c not in long.columns])
    docs = odd.unionByName(more).unionByName(more.where("doc_id = 21"))
    for table, rows in ((docs, True), (docs.limit(0), False)):
        seen = table
        for name, stage in corpus_pipeline.STAGES:
            seen = stage(spark, seen, str(tmp_path)).cache()
            if name == "tokens":
                assert set(seen.columns) >= {"token_ids", "n_tokens", "SIMHASH", "kept"} and len(seen.columns) == len({c.lower() for c in seen.columns})
            else:
                assert seen.columns == docs.columns
                assert seen.where("kept <> 'own' or score <> 'own' or SIMHASH <> 'own'").count() == 0
        assert (seen.count() > 0) == rows
