import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from strideframe.llm import licenses, quality, toxicity

RNG = random.Random(7)
SYLLABLES = ["an", "er", "on", "ti", "re", "st", "en", "or", "ha", "ly", "nd", "es"]


def prose(n):
    words = ["".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if RNG.random() < 0.1 else "") for w in words).capitalize()


INSULTS = ["blockhead", "nitwit", "scoundrel"]


def insulting(n):
    words = prose(n).split(" ")
    words.insert(RNG.randrange(len(words)), RNG.choice(INSULTS))
    return " ".join(words)


@pytest.fixture(scope="module")
def toxic_model():
    texts = [insulting(30) for _ in range(150)] + [prose(30) for _ in range(300)]
    return toxicity.fit(texts, [1] * 150 + [0] * 300)


def test_toxicity_held_out_accuracy(toxic_model):
    bad = toxic_model.scores([insulting(40) for _ in range(200)])
    good = toxic_model.scores([prose(40) for _ in range(200)])
    assert (bad >= 0.3).mean() > 0.97 and (good >= 0.3).mean() < 0.03


def test_toxicity_takes_disguises(toxic_model):
    plain = toxic_model.scores([prose(30) for _ in range(50)]).max()
    for text in ("you block*head there", "you n i t w i t there", "a scounndrel indeed", "a BLOCKHEAD, indeed"):
        assert toxic_model.scores([text])[0] > max(plain, 0.3), text


def test_kernel_is_what_the_table_sums():
    words = ["blockhead", "nitwit", "ahead", "block"]
    landmarks = toxicity.Landmarks(words)
    beta = np.array([1.0, -0.5, 0.25, 2.0])
    for w in ("blokhead", "nit-wit", "x"):
        direct = float(landmarks.kernel([w])[0] @ beta)
        assert abs(direct - toxicity.Words([w]).margins(landmarks.table(beta))[0]) < 1e-4
    assert np.allclose(np.linalg.eigvalsh(landmarks.kernel(words).astype(float)).min().clip(max=0), 0, atol=1e-5)


def plain_kernel(a, b):
    """The kernel of two words by its definition: weights of common triples, over norms; a word's limits are characters of it."""

    def triples(word):
        chars, out = f" {word} ", Counter()
        for i, j, k in combinations(range(len(chars)), 3):
            if k - i < toxicity.SPAN:
                out[chars[i], chars[j], chars[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    return sum(v * y[t] for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_is_the_gapped_kernel():
    words = ["blockhead", "wretch", "block*head", "headblock", "blokhead", "übelkat"]
    found = toxicity.Landmarks(words).kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            # Words without a triple twice have the same norm as by the definition.
            assert abs(found[i, j] - plain_kernel(a, b)) < 1e-3, (a, b)
    assert found[0, 2] > 0.3 > found[0, 1]


def test_documents_with_single_letters_are_learnt_from():
    letters = lambda t: f"x y z w {t} q r s"
    model = toxicity.fit([letters(insulting(30)) for _ in range(120)] + [letters(prose(30)) for _ in range(240)], [1] * 120 + [0] * 240)
    assert (model.scores([insulting(40) for _ in range(100)]) >= 0.3).mean() > 0.95 and (model.scores([prose(40) for _ in range(100)]) >= 0.3).mean() < 0.05


def test_toxicity_query_shape(spark, odd, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    df = documents([(i, insulting(20) if i % 2 else prose(20)) for i in range(200)])
    rows = toxicity.toxicity(df, labels, keep=["doc_id"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    strange = toxicity.toxicity(odd, labels).collect()
    assert len(strange) == odd.count() and not any(r.score is None for r in strange)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0), keep=["doc_id"]).collect()} == {0.0}


def test_repeated_words():
    assert quality.repeated_words("a b c".encode().split()) == 0
    assert quality.repeated_words("a b c a b c".encode().split()) == 6
    assert quality.repeated_words("a b c d a b c".encode().split()) == 6
    assert quality.repeated_words(b"x x x x".split()) == 4
    assert quality.repeated_words(b"x x".split()) == 0
    assert quality.base_features("a b\n\n a b\na b\n#x\n") == (7, 8, 1, 1, 6)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = set()
    for i in range(len(words) - 2):
        if sum(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2)) > 1:
            covered |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_base_features_and_score_against_brute_force(spark, documents):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a ", "b ", "ü", "#", "\n", "\x0b", "\xa0", "x y z ", "<|>", "\U0001f600 "]) for _ in range(rng.randint(0, 150))) for _ in range(200)]
    assert [quality.base_features(t) for t in texts] == [plain_base(t) for t in texts]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judge(documents(list(enumerate(texts))), labels, keep=["doc_id"]).collect()}

    def grams(text):
        a = text.encode()
        return [((a[i] << 16 | a[i + 1] << 8 | a[i + 2]) * 2654435761 % (1 << 32)) >> (32 - quality.BUCKET_BITS) for i in range(len(a) - 2)]

    order = spark.createDataFrame([(i,) for i in range(200)], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 2) = 0 AS fit").collect()
    fit = {r.doc_id for r in order if r.fit}
    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in fit and i % 2:
            target.update(grams(t))
    n = 1 << quality.BUCKET_BITS
    share = lambda c, g: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * n))
    for i, t in enumerate(texts):
        g = grams(t)
        score = sum(share(target, x) - share(raw, x) for x in g) / len(g) if g else 0.0
        assert abs(found[i].score - score) < 1e-6


def test_quality_keeps_good_and_drops_bad(spark, documents, odd):
    bad = lambda n: "### ".join(prose(n).split(" "))
    df = documents([(i, bad(80) if i % 5 == 0 else prose(80)) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(150)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.judge(df, labels, keep=["doc_id"]).collect()}
    assert all(r.kept == (i % 5 != 0) for i, r in rows.items())
    strange = quality.judge(odd, labels).collect()
    assert len(strange) == odd.count()
    for r in strange:
        words = (r.text or "").encode().split()
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(odd.limit(0), labels).count() == 0
    alone = quality.judge(df, labels.limit(0), keep=["doc_id"]).collect()
    assert all(r.kept for r in alone)


def test_quality_threshold():
    assert quality.best_threshold(np.array([1.0, 2.0]), np.array([-1.0, 0.0])) == 0.5
    assert quality.best_threshold(np.array([]), np.array([1.0])) == float("-inf")


def labelled(n=44_000):
    """Texts and the quality of each: more labels than any sample, and words that part the qualities badly."""
    rng = random.Random(5)
    quality_of = [int(rng.random() < 0.7) for _ in range(n)]
    words = [[f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "ijk"], [f"{a}{b}{c}" for a in "abcd" for b in "efgh" for c in "lmn"]]
    return [" ".join(rng.choice(words[rng.random() < 0.45 + 0.1 * q]) for _ in range(52)) for q in quality_of], quality_of


def plain_quality(spark, texts, quality_of, base_failed):
    """Score and verdict of each text from all labels."""
    fit = np.array([r.fit for r in spark.range(len(texts)).selectExpr("pmod(xxhash64(id, 5), 2) = 0 AS fit").collect()])
    grams, good, size = [quality.buckets(t) for t in texts], np.array(quality_of) == 1, 1 << quality.BUCKET_BITS
    count = lambda chosen: np.bincount(np.concatenate([grams[i] for i in np.flatnonzero(chosen)]), minlength=size).astype(float)
    ratios = quality.log_ratios(count(fit | ~fit), count(fit & good))
    scores = np.array([ratios[g].mean() for g in grams])
    judged = ~fit & ~base_failed
    return scores, ~base_failed & (scores >= quality.best_threshold(scores[judged & good], scores[judged & ~good]))


def test_quality_learns_from_every_label(spark, documents):
    """Target counts and the threshold come from all labels."""
    texts, quality_of = labelled()
    labels = spark.createDataFrame(list(enumerate(quality_of)), "doc_id long, quality int")
    found = quality.judge(documents(list(enumerate(texts))), labels, keep=["doc_id"]).toPandas().sort_values("doc_id")
    scores, kept = plain_quality(spark, texts, quality_of, found["base_failed"].to_numpy())
    assert np.allclose(found["score"].to_numpy(), scores, atol=1e-12, rtol=0) and (found["kept"].to_numpy() == kept).all()


def test_quality_threshold_by_ranges(spark):
    rng = random.Random(3)
    for values in (6, 60, 10**9):
        rows = [(rng.randrange(values) / 8, rng.random() < 0.5) for _ in range(700)]
        rows = [(s + 0.2 * values / 8 * g, g) for s, g in rows]
        plain = quality.best_threshold(np.array([s for s, g in rows if g]), np.array([s for s, g in rows if not g]))
        assert quality.threshold_of(spark.createDataFrame(rows, "score double, good boolean").repartition(5)) == plain
    assert quality.threshold_of(spark.createDataFrame([(1.0, True)], "score double, good boolean")) == float("-inf")
    assert quality.threshold_of(spark.createDataFrame([(1.0, False), (2.0, True)], "score double, good boolean")) == 1.5
    assert quality.threshold_of(spark.createDataFrame([(1.0, True), (2.0, False)], "score double, good boolean")) == float("-inf")


@pytest.fixture(scope="module")
def license_model():
    return licenses.train([prose(40) for _ in range(60)])


def test_license_families(license_model):
    for text, family in (("Licensed under the Apache License, Version 2.0.", "Apache"), ("released under the MIT license", "MIT"), ("Distributed under the GNU General Public License, version 3", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC")):
        body = f"{prose(20)}\n{text}\n{prose(20)}"
        (span,) = licenses.scan_texts(license_model, [body])[0]
        assert span[0] == family and span[4] and body.encode()[span[1] : span[2]].decode() == text
    for text in ("a licensed plumber at work", "All rights reserved.", "", prose(200)):
        assert licenses.scan_texts(license_model, [text])[0] == []


def wrapped(text, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line.strip())
            line = ""
        line += w + " "
    return "\n".join([*lines, line.strip()])


def test_whole_license_texts_wrapped_and_long_paragraphs(license_model):
    for text, family in ((licenses.MIT_TEXT, "MIT"), (licenses.BSD_TEXT, "BSD"), (licenses.ISC_TEXT, "ISC"), (licenses.APACHE_TEXT, "Apache")):
        for width in (40, 72, 10_000):
            spans = licenses.scan_texts(license_model, [f"{prose(20)}\n\n{wrapped(text, width)}\n\n{prose(20)}"])[0]
            assert any(s[0] == family and s[4] for s in spans), (family, width)
    far = f"{prose(600)}\n{licenses.TEMPLATES['GPL'][0]}"
    assert [s[0] for s in licenses.scan_texts(license_model, [far])[0]] == ["GPL"]


def test_license_families_held_out(license_model):
    """Notices in words that no template has, and prose with the same words."""
    unseen = [
        ("This project is distributed under the terms of the MIT License.", "MIT"), ("The code is available under the Apache License 2.0.", "Apache"), ("Covered by the GNU General Public License v3.", "GPL"),
        ("Released under the Mozilla Public License, version 2.0.", "MPL"), ("This file is licensed under the GNU Lesser General Public License.", "LGPL"), ("Text available under CC BY-SA 4.0.", "CC-BY-SA"),
    ]
    found = [[s[0] for s in licenses.scan_texts(license_model, [t])[0]] for t, _ in unseen]
    assert sum(f == [k] for f, (_, k) in zip(found, unseen)) >= 5, found
    clean = [prose(30) for _ in range(200)] + ["They gave permission to use the room.", "The mit of the baker was warm.", "The warranty ended in March."]
    assert sum(bool(licenses.scan_texts(license_model, [t])[0]) for t in clean) <= 1


def test_license_query_takes_odd_rows(odd):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count() and {r.license_status for r in rows} == {"none"}
    assert licenses.scan(odd.limit(0)).count() == 0
