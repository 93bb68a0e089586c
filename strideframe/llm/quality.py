"""Operator 4: quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: the trusted target (labelled documents of
quality 1) and the raw corpus (all documents). A document's score is the mean, over
its n-grams, of the log ratio of the two, so it doesn't depend on the length. A
document is kept if it passes the base rules and its score reaches a threshold; the
same tables and labels always give the same threshold and verdicts.

The raw counts cover every document, and every labelled document takes part in one
of two halves, by a hash of its doc_id: those of quality 1 in one half are the
target, all of the other half that pass the base rules set the threshold, where it
parts quality 1 from 0 best (Youden's index; of equal thresholds the lowest).
Labels meet texts by joins, and the threshold is found in ranges of the scores, so
no label or score is sent to all tasks or to the driver.

Defined cases: a null text is an empty one and fails the base rules; without labels
of both kinds there is no threshold, and the base rules alone decide; very long texts are
judged whole; repeated rows are judged and count each; an empty table gives an empty result; kept
columns named as results give way to them, all others may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACES, append_arrow, cut, on_workers

ORDER = 3
BUCKET_BITS = 16
SMOOTHING = 0.5
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

BASE = [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
VERDICT = [*BASE, T.StructField("base_failed", T.BooleanType(), False), T.StructField("score", T.DoubleType(), False)]


def buckets(text: str) -> np.ndarray:
    """The bucket of each n-gram of the text's bytes."""
    a = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(a) < ORDER:
        return np.zeros(0, np.uint32)
    n = len(a) - ORDER + 1
    gram = a[:n]
    for k in range(1, ORDER):
        gram = gram << np.uint32(8) | a[k : k + n]
    return (gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def repeated_words(words: Sequence[bytes], n: int = 3) -> int:
    """Words in windows of ``n`` words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(n):
        covered[k : k + len(windows)] |= again
    return int(covered.sum())


def base_features(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


def _judge(df: DataFrame, text: str, ratios: np.ndarray, keep: Sequence[str] | None) -> DataFrame:
    """``df`` with the columns ``VERDICT``."""

    def make():
        def run(column: pa.Array) -> list[pa.Array]:
            rows = []
            for t in column.to_pylist():
                t = t or ""
                base = base_features(t)
                at = buckets(t)
                rows.append((*base, base_failed(base[0], base[4]), float(ratios[at].mean()) if len(at) else 0.0))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]
            return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]

        return run

    return append_arrow(df, [text], VERDICT, make, keep)


def corpus_counts(df: DataFrame, text: str) -> np.ndarray:
    """N-gram counts by bucket over all of ``df``."""
    n = 1 << BUCKET_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts += np.bincount(buckets(t or ""), minlength=n)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["bucket", "n"])

    partial = on_workers(df.select(F.col(f"`{text}`"))).mapInArrow(run, "bucket int, n long")
    counts = np.zeros(n)
    for bucket, found in partial.groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket at most
        counts[bucket] = found
    return counts


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return share(trusted) - share(raw)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap between scores at which Youden's index is largest; minus infinity without scores of both kinds."""
    if not len(good) or not len(bad):
        return -math.inf
    values = np.unique(np.concatenate((good, bad)))
    below_good = np.searchsorted(np.sort(good), values, "left") / len(good)
    below_bad = np.searchsorted(np.sort(bad), values, "left") / len(bad)
    i = int(np.argmax(below_bad - below_good))
    return float((values[i - 1] + values[i]) / 2) if i else -math.inf


def threshold_of(scores: DataFrame) -> float:
    """``best_threshold`` of all rows (score, and good or not), by ranges of the scores; only a range's sums reach the driver."""
    counted = scores.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    values = cut(counted.repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    sums = values.groupBy("range").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).orderBy("range").collect()
    n_good, n_bad = sum(r.good for r in sums), sum(r.bad for r in sums)
    if not n_good or not n_bad:
        return -math.inf
    rows, good, bad, last = [], 0, 0, None
    for r in sums:
        rows.append((r.range, good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r.last
    starts = scores.sparkSession.createDataFrame(rows, "range int, good_before long, bad_before long, last_before double")
    order = Window.partitionBy("range").orderBy("score")
    below = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gain = below("bad") * n_good - below("good") * n_bad
    found = values.join(F.broadcast(starts), "range").select(gain.alias("gain"), (-F.col("score")).alias("lowest"), F.coalesce(F.lag("score").over(order), "last_before").alias("before"))
    best = found.agg(F.max(F.struct("gain", "lowest", "before")).alias("best")).first().best
    return -math.inf if best.before is None else (best.before - best.lowest) / 2


def judge(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    ``labels`` has ``key`` and quality (1 for trusted). Of the texts, the half that the target may come from is joined with
    labels; of the other half the scores are. A text's key tells its half and a label follows its text, so keys of
    another type, such as int beside long, lose no label.
    """
    fit = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(2)) == 0
    known = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max("quality").alias("quality"))
    texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("key").isNotNull())
    raw = corpus_counts(df, text)
    # By shuffle at any size, so what moves grows with the texts only.
    target = texts.where(fit).join(known.where("quality = 1").hint("shuffle_hash"), "key", "left_semi")
    trusted = corpus_counts(target, "text")
    if not trusted.any():
        ratios, threshold = np.zeros(len(raw)), -math.inf
    else:
        ratios = log_ratios(raw, trusted)
        scored = _judge(texts.where(~fit), "text", ratios, ["key"]).where("not base_failed").select("key", "score")
        threshold = threshold_of(scored.join(known, "key").select("score", (F.col("quality") == 1).alias("good")))
    return _judge(df, text, ratios, keep).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
