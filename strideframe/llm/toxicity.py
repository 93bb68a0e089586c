"""Operator 1: toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by the triples of characters that they share in
order. A triple may have gaps, up to SPAN characters in all, and counts with DECAY
to the power of its span; a word's limits count as characters. So an insult with
inserted or dropped characters still shares most triples with the plain one. Single
characters in a row, parted by spaces, are read as one word.

Landmarks are words of the labelled sentences: those that tell toxic documents most,
the most frequent ones of clean documents, and clean words like toxic ones. The
Nyström map turns a word into its kernel values against the landmarks, whitened. A
sentence's margin is the largest of its words'. A squared-hinge SVM is trained on the
sentences of labelled documents: of a clean document each sentence is clean, of a toxic
one at least one is toxic, and it is the one whose word it takes for the most toxic
(first by frequency, then by its own margin), besides those with a frequent word that
clean documents hardly have; clean sentences of the largest margin are
added round by round. A document's margin is the largest of its sentences', and a
logistic curve fitted on documents that the SVM has not seen turns it into a score.

A margin is a sum over landmarks of kernel values, and a kernel value a sum over
triples, so the sum over landmarks is taken once, into a table by hashed triple;
scoring a text is a lookup for each of its triples.

The SVM is fitted on a bounded sample of labelled rows: SAMPLE of each kind at most,
the first by a hash of their doc_id. Of the sample's distinct clean words CLEAN_WORDS at
most are compared with the landmarks and NEGATIVES of these are learnt from the start;
each round adds WORST at most. These bound the training only: every word is scored.

Defined cases: a null text is an empty one; a text without words has the score of the
lowest margin; very long texts are scored whole; without training rows of both kinds every
score is 0; repeated rows are scored each; an empty table gives an empty result; kept
columns named as results give way to them, all others may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow, chunks

SPAN = 5
DECAY = 0.6
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
TABLE_BITS = 20
CHUNK = 500_000
SAMPLE = 1500
LANDMARKS = 300
CLEAN_WORDS = 8000
NEGATIVES = 4000
WORST = 1000
#: A telling word in so large a share of the documents of the most frequent one is toxic in every sentence.
PLAIN = 0.3
#: The largest weight of a toxic and of a clean word, which grows with its documents.
MOST_TOXIC, MOST_CLEAN = 20, 20
ROUNDS = 6
RIDGE = 1e-3
COST = 10.0
LOWEST = -3.0

_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


class Words:
    """The words of some texts as one array of code points, parted by blanks; single letters in a row are one word unless ``join`` is false."""

    def __init__(self, texts: Sequence[str], join: bool = True) -> None:
        joined = "".join(f" {t.lower()} " for t in texts)
        sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        blank = (cp == 0x20) | ((cp >= 0x09) & (cp <= 0x0D)) | (cp == 0xA0)
        limits = np.cumsum(sizes)
        if join:
            cp, blank, limits = _join_single_letters(cp, blank, limits)
        self.cp = np.where(blank, np.uint32(0x20), cp)
        self.blank = blank
        edge = np.flatnonzero(np.diff(blank.view(np.int8)))
        self.starts, self.ends = edge[0::2] + 1, edge[1::2] + 1
        #: Each text's first word, with the number of words last.
        self.first = np.searchsorted(self.starts, np.concatenate(([0], limits)))

    def triples(self):
        """For each pair of offsets: where a triple's middle is, its hash, whether it stands, and its weight."""
        n = len(self.cp)
        parts = [self.cp * m for m in _MIX]
        blanks = np.cumsum(self.blank, dtype=np.int32)
        for a, b in OFFSETS:
            if n <= b:
                continue
            h = parts[0][: n - b] + (parts[1][a : n - b + a] ^ (parts[1][a : n - b + a] >> np.uint32(13))) + (parts[2][b:] ^ (parts[2][b:] >> np.uint32(7)))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
            yield a, h >> np.uint32(32 - TABLE_BITS), blanks[b - 1 : n - 1] == blanks[: n - b], np.float32(DECAY ** (b + 1))

    def norms(self) -> np.ndarray:
        """Each word's norm, which hangs on its length alone."""
        size = self.ends - self.starts + 2
        total = sum(np.maximum(size - b, 0) * DECAY ** (2 * (b + 1)) for _, b in OFFSETS)
        return np.sqrt(np.maximum(total, 1e-9))

    def margins(self, table: np.ndarray) -> np.ndarray:
        """For each word the inner product of its normed triples with ``table``."""
        if not len(self.starts):
            return np.zeros(0)
        held = np.zeros(len(self.cp), np.float32)
        for a, h, stands, weight in self.triples():
            held[a : a + len(h)] += table[h] * (stands * weight)
        return np.add.reduceat(held, self.starts, dtype=np.float64) / self.norms()

    def texts(self) -> list[str]:
        chars = self.cp.tobytes()
        return [chars[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def _join_single_letters(cp: np.ndarray, blank: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the blanks between three or more single characters in a row of one text."""
    alone = ~blank[1:-1] & blank[:-2] & blank[2:]
    at = np.flatnonzero(alone) + 1
    if len(at) < 3:
        return cp, blank, limits
    near = np.diff(at) == 2
    long = near.copy()
    long[1:] &= near[:-1]
    ends = long.copy()
    ends[:-1] |= long[1:]
    drop = at[:-1][ends] + 1  # blanks between neighbours of a run of three
    keep = np.ones(len(cp), bool)
    keep[drop] = False
    return cp[keep], blank[keep], limits - np.searchsorted(drop, limits)


def _sparse(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as rows, columns and values of their normed triples."""
    of = Words(words, join=False)
    owner = np.repeat(np.arange(len(of.starts)), of.ends - of.starts)
    where = np.full(len(of.cp), -1)
    where[~of.blank] = owner
    norms, rows, columns, values = of.norms(), [], [], []
    for a, h, stands, weight in of.triples():
        middle = where[a : a + len(h)]
        good = stands & (middle >= 0)
        rows.append(middle[good])
        columns.append(h[good])
        values.append(weight / norms[middle[good]])
    return np.concatenate(rows), np.concatenate(columns).astype(np.int64), np.concatenate(values)


class Landmarks:
    """Kernel values against landmarks."""

    def __init__(self, words: Sequence[str]) -> None:
        self.rows, self.columns, self.values = _sparse(words)
        self.n = len(words)
        self.known, at = np.unique(self.columns, return_inverse=True)
        self.matrix = np.zeros((len(self.known), self.n), np.float32)
        np.add.at(self.matrix, (at, self.rows), self.values)

    def kernel(self, words: Sequence[str]) -> np.ndarray:
        rows, columns, values = _sparse(words)
        at = np.minimum(np.searchsorted(self.known, columns), len(self.known) - 1)
        good = self.known[at] == columns
        rows, at, values = rows[good], at[good], values[good]
        out = np.zeros((len(words), self.n), np.float32)
        order = np.argsort(rows, kind="stable")
        rows, at, values = rows[order], at[order], values[order]
        for i in range(0, len(rows), 50_000):
            part = self.matrix[at[i : i + 50_000]] * values[i : i + 50_000, None].astype(np.float32)
            firsts = np.flatnonzero(np.diff(rows[i : i + 50_000], prepend=-1))
            out[rows[i : i + 50_000][firsts]] += np.add.reduceat(part, firsts, axis=0)
        return out

    def table(self, beta: np.ndarray) -> np.ndarray:
        """Of the expansion with these coefficients, the sum for each hashed triple."""
        out = np.zeros(1 << TABLE_BITS, np.float32)
        np.add.at(out, self.columns, self.values * beta[self.rows])
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    inside = None
    for _ in range(rounds):
        now = y * (x1 @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        a, c = x1[inside], COST * weight[inside]
        w = np.linalg.solve(ridge + a.T @ (a * c[:, None]), a.T @ (c * y[inside]))
    return w[:-1], float(w[-1])


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, texts: Sequence[str]) -> np.ndarray:
        """Each text's largest margin; LOWEST without words."""
        out = np.full(len(texts), LOWEST)
        for a, b in chunks([len(t) for t in texts], CHUNK):
            words = Words(texts[a:b])
            each = words.margins(self.table) + self.bias
            some = np.flatnonzero(np.diff(words.first))
            if len(some):
                out[a + some] = np.maximum.reduceat(each, words.first[some])
        return np.maximum(out, LOWEST)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(texts) + self.offset)))


NEVER = Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, 0.0, -745.0)


def disguises(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a mark inserted, a letter stretched, a letter replaced, and marks throughout."""
    i = int(rng.integers(1, len(word)))
    mark = "*.-_#"[int(rng.integers(5))]
    return [word[:i] + mark + word[i:], word[:i] + word[i - 1] * 2 + word[i:], word[: i - 1] + mark + word[i:] if i > 1 else word + mark, mark.join(word)]


def logistic(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets drawn in from 0 and 1, by Newton steps."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(texts: Sequence[str], toxic: Sequence[int], seed: int = 1) -> Model:
    """The model of labelled texts; a third of them only sets the logistic curve."""
    toxic = np.array(toxic, bool)
    rng = np.random.default_rng(seed)
    if not toxic.any() or toxic.all():
        return NEVER
    bags = [sorted(set(Words([t]).texts())) for t in texts]
    held = np.zeros(len(texts), bool)
    for kind in (True, False):
        own = rng.permutation(np.flatnonzero(toxic == kind))
        held[own[: len(own) // 3]] = True
    bad = [b for b, x, h in zip(bags, toxic, held) if x and not h and b]
    good = [b for b, x, h in zip(bags, toxic, held) if not x and not h and b]
    if not bad or not good:
        return NEVER
    in_bad, in_good = Counter(w for b in bad for w in b), Counter(w for b in good for w in b)
    odds = {w: np.log((n + 0.1) / (len(bad) + 1)) - np.log((in_good[w] + 0.1) / (len(good) + 1)) + 0.3 * np.log(n) for w, n in in_bad.items() if n > 1 or len(bad) < 5}
    if not odds:
        return NEVER
    strongest = sorted(odds, key=lambda w: (-odds[w], w))[: LANDMARKS // 2]
    frequent = [w for w, _ in sorted(in_good.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS // 4]]
    common = set(strongest) | set(frequent)
    first = Landmarks(sorted(common))
    clean_words = sorted(in_good)
    looked = [clean_words[i] for i in rng.permutation(len(clean_words))[:CLEAN_WORDS]]
    like = first.kernel(looked)[:, [i for i, w in enumerate(sorted(common)) if w in odds and odds[w] > 0]].max(1)
    alike = [looked[i] for i in np.argsort(-like, kind="stable")[: LANDMARKS // 4]]
    chosen = sorted(common | set(alike))
    landmarks = Landmarks(chosen)
    values, vectors = np.linalg.eigh(landmarks.kernel(chosen).astype(np.float64) + RIDGE * np.eye(len(chosen)))
    whiten = vectors / np.sqrt(np.maximum(values, RIDGE))  # the Nyström map, up to a rotation
    features = lambda words: landmarks.kernel(words) @ whiten.astype(np.float32)

    witness = Counter(max(b, key=lambda w: (odds.get(w, -99.0), w)) for b in bad)
    negatives = dict.fromkeys([looked[i] for i in range(min(NEGATIVES, len(looked)))] + frequent + alike)
    # By shares, as some labels are wrong: a word in eight times the share of toxic documents, and in two of them at least.
    telling = lambda w: in_bad[w] > 1 and in_bad[w] / len(bad) > 8 * in_good[w] / len(good)
    most = max((n for w, n in in_bad.items() if telling(w)), default=0)
    plain = {w: float(min(n, MOST_TOXIC)) for w, n in in_bad.items() if telling(w) and n >= PLAIN * most}
    model = NEVER
    for _ in range(ROUNDS):
        positive = {w: float(min(n, MOST_TOXIC)) for w, n in witness.items() if telling(w)} | plain
        for w in [w for w, n in positive.items() if n >= 5 and len(w) > 3]:  # learnt in disguise as well
            positive |= {x: positive[w] / 8 for x in disguises(w, rng) if x not in in_good and x not in positive}
        others = [w for w in negatives if w not in positive and not telling(w)]
        words = [*positive, *others]
        y = np.array([1.0] * len(positive) + [-1.0] * len(others))
        weight = np.array([*positive.values(), *(float(min(max(in_good[w], 1), MOST_CLEAN)) for w in others)])
        w, bias = squared_hinge(features(words), y, weight)
        model = Model(landmarks.table(whiten @ w), bias, 1.0, 0.0)
        of_bag = lambda bag: Words([" ".join(bag)], join=False).margins(model.table)  # noqa: B023, E731
        witness = Counter(bag[int(np.argmax(of_bag(bag)))] for bag in bad)
        worst = [(float(m.max()), bag[int(np.argmax(m))]) for bag in good for m in (of_bag(bag),)]
        negatives |= dict.fromkeys(w for m, w in sorted(worst, reverse=True)[:WORST] if m + bias > -1)
    at = np.flatnonzero(held)
    if not toxic[at].any() or toxic[at].all():
        at = np.arange(len(texts))
    slope, offset = logistic(model.margins([texts[i] for i in at]), toxic[at])
    return Model(model.table, model.bias, slope, offset)


def training_sample(df: DataFrame, labels: DataFrame, text: str, key: str, most: int) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out rows, ``most`` of each kind at most."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.col(key), F.lit(1)), F.col(key)]
    kinds = [usable.where(c).orderBy(*order).limit(most) for c in ("toxic = 1", "toxic = 0")]
    chosen = kinds[0].unionByName(kinds[1])
    found = df.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    rows = found.groupBy(key).agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()  # of rows that share a doc_id the least text
    rows = sorted(((r[0], r["text"] or "", r["toxic"]) for r in rows))
    return [t for _, t, _ in rows], [x for _, _, x in rows]


def held_out(key) -> F.Column:
    """Whether a row is kept from training: the CRC-32 of its number as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the score of each text, from 0 to 1."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            return [pa.array(model.scores([t or "" for t in column.to_pylist()]), pa.float64())]

        return run

    return append_arrow(df, [text], [T.StructField(output, T.DoubleType(), False)], make, keep)


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3, sample: int = SAMPLE, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with held_out, score and predicted; the model learns from ``labels`` (``key``, toxic) less the held-out rows."""
    model = fit(*training_sample(df, labels, text, key, sample))
    scored = score(df, model, text, "score", keep)
    return scored.withColumn("held_out", held_out(F.col(key))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
