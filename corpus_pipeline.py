"""From raw documents to tokens: training-data operators one after another.

Each stage works on all that the one before it kept. All but the last return the
columns of ``documents``; the last adds the tokens to them.

Defined cases: a null or empty text fails the quality rules; of repeated rows one stays
(near_duplicates), but rows without a doc_id all stay; an empty table gives empty
results; columns that ``documents`` doesn't have go through every stage as they are,
whatever their names, except that the last stage's results take the place of columns
of their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, mixing, quality, simhash, substring_dedup
from strideframe.llm.common import cut, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shielded(stage: Stage) -> Stage:
    """``stage`` with all other columns under names that clash with none of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = {c: f"__other_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]), sf_dir)
        own, made = {v: k for k, v in others.items()}, {c.lower() for c in out.columns}
        return out.select(*[F.col(c).alias(own.get(c, c)) for c in out.columns if own.get(c, "").lower() not in made])

    return run


@shielded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


@shielded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Near is what the fingerprints' contract says: four words, four bits. Every link of
    these is found; of texts with a similarity of 0.8, 0.9 and 0.95 it is 3, 20 and 50
    percent that lie so near, so this takes out copies and slight edits, no more.
    """
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


@shielded
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that an earlier one has; words are then parted by one space."""
    cleaned = substring_dedup.remove_repeats(docs, outputs=("n_removed", "kept_text"))
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")
    return cleaned.withColumn("n_chars", n_chars).withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).select(*docs.columns)


@shielded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: a row for each whole time that a document is taken, and one for the rest."""
    return mixing.mixed_documents(docs)


@shielded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their tokens."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), outputs=("token_ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("tokens", tokens),
]

#: Hashed n-gram scores, fingerprints and merges have no SQL form; tests hold each operator, and run() as a whole, against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is kept in the shared checkpoint folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
