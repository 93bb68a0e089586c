"""Operator 6: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by a hash, are one stream of words cut
into blocks of equal length; the stream runs through the source at most twice. Slot i
of the mix lies at the fractional part of i times the golden ratio. The point falls
into a source's share of the cumulated targets, and the source's j-th slot takes its
j-th block. A document's share of the mix is what its words have in taken blocks. As
blocks are taken in their order, what a source gives is its stream's beginning: whole
documents, and of the last one its first words.

Running sums are made in two levels (groups, then within a group), so that a source
with most of the rows is not summed in one task. All of it is DataFrame functions.

Defined cases: a null text has no words; a null source is a source, the last one; a
document without words is in no block; very long texts are cut into as many blocks as they
take; repeated rows are documents of their own; equal rows may stand in for each other;
empty tables give empty results; other columns may have any names but for the mix's
documents, where those that begin with two underscores are the operator's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, without

WEIGHTS = (3, 1, 2)
#: The points' circle, and an odd number next to its golden section.
CIRCLE = 1 << 48
GOLDEN = 173961102589771
CELLS = 4096
#: Up to so many sources, their table (some hundred bytes each) is sent to every task.
BROADCAST_SOURCES = 10_000
HASH_BITS = 62


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source: number (from 0 by code point, null last), source_size and target.

    A source is at its limit if a level that only the sources with lower limits to
    their weight have left reaches its own; the others share the rest by weight.
    The windows run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    limits = ordered.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    limits = limits.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left_weights = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    full = limits.withColumn("full", left / left_weights >= F.col("limit") / F.col("weight"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(whole)
    rest_weights = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("limit")).otherwise(rest / rest_weights * F.col("weight"))
    return full.select("source", "number", "source_size", target.alias("target"))


def golden_point(slot: Column) -> Column:
    """``slot`` times GOLDEN on the circle, from products of 24 bits that don't overflow."""
    half, low = 1 << 24, lambda c: c.bitwiseAND(F.lit((1 << 24) - 1))
    at, g1, g0 = slot % CIRCLE, GOLDEN >> 24, GOLDEN % half
    return (low(at) * g0 + low(low(at) * g1 + F.shiftright(at, 24) * g0) * half) % CIRCLE


def schedule(sources: DataFrame, block: int, maybe_broadcast) -> DataFrame:
    """The mix's slots: number of the source, rank of the slot within it from 0, and slot."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    n = math.ceil(total / block)
    cell = CIRCLE // CELLS
    upto = F.sum("target").over(Window.orderBy("number"))
    bound = lambda x: F.round(x / F.lit(total or 1.0) * CIRCLE).cast("long")
    shares = (
        sources.select("number", bound(upto - F.col("target")).alias("low"), bound(upto).alias("high"))
        .where("low < high")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    )
    point = golden_point(F.col("id"))
    slots = sources.sparkSession.range(n).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point / cell).alias("cell"))
    placed = slots.join(maybe_broadcast(shares), "cell").where("point >= low and point < high")
    chunk = max(4096, math.isqrt(n))
    placed = placed.select("number", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = placed.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("number", "chunk", earlier.alias("earlier"))
    own = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    return placed.join(counts, ["number", "chunk"]).select("number", (F.col("earlier") + own).alias("block"), "slot")


def streams(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """``rows`` (row, doc_id, mark, number, size) with the place at which each begins in its source's stream.

    The order is a hash of the doc_id and of ``mark``, the text's own: rows without a doc_id, or with one, may be many.
    """
    bits = max(4, math.isqrt(max(n_rows, 1)).bit_length())
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 64 - HASH_BITS)
    hashed = rows.withColumn("order", order).withColumn("bucket", F.shiftright("order", HASH_BITS - bits))
    sums = hashed.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("number", "bucket", earlier.alias("earlier"))
    within = Window.partitionBy("number", "bucket").orderBy("order", "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("earlier") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return hashed.join(sums, ["number", "bucket"]).withColumn("start", start)


def _taken(sizes: DataFrame, block: int = 32, seed: int = 7, share: float = 1.5) -> DataFrame:
    """``sizes`` (row, doc_id, source, size, mark; kept, as it is read several times) with source_size, target and taken."""
    sources = cut(targets(sizes, share))
    n_sources, n_rows = sources.count(), sizes.count()
    maybe_broadcast = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda x: x
    named = sources.withColumnRenamed("source", "source_name")
    rows = sizes.join(maybe_broadcast(named), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    placed = streams(rows.where("size > 0").select("row", "doc_id", "mark", "number", "size", "source_size"), n_rows, seed)
    passes = placed.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    passes = passes.select("row", "number", (F.col("start") + F.col("pass") * F.col("source_size")).alias("a"), "size").withColumn("b", F.col("a") + F.col("size"))
    first, last = F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)
    pieces = passes.select("row", "number", "a", "b", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least("b", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    pieces = pieces.select("row", "number", "block", words.alias("words"))
    taken = pieces.join(schedule(sources, block, maybe_broadcast), ["number", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("row", "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _sizes(text: str, source: str, key: str) -> list[Column]:
    return [F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("mark")]


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = 32, seed: int = 7, share: float = 1.5) -> DataFrame:
    """For each row: doc_id, size, source, source_size, target and taken."""
    sizes = cut(df.select(*_sizes(text, source, key)).withColumn("row", F.monotonically_increasing_id()))
    return _taken(sizes, block, seed, share).drop("row")


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", chars: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: a row for each whole time that a document is taken, and one with the words that are taken besides, which are its first ones.

    Each row of ``df`` is a document of its own, whether or not others share its ``key``; the columns are those of ``df``.
    """
    # Numbered once and kept: numbers given anew to the rows could fall to others.
    numbered = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    sizes = cut(numbered.select(*_sizes(text, source, key), F.col("__row").alias("row")))
    taken = _taken(sizes, **options).where("taken > 0").select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    joined = numbered.join(taken, "__row")
    times = F.floor(F.col("__taken") / F.col("__size"))
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), times.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))  # with the white space before them
    cut_text = F.when(F.col("__part") == 0, F.col(text)).otherwise(F.array_join(F.slice(words, 1, F.greatest("__part", F.lit(1))), ""))
    out = joined.withColumn("__part", F.explode(parts)).withColumn(text, cut_text)
    if chars in df.columns:
        out = out.withColumn(chars, F.length(text).cast("long"))
    return without(out, ["__row", "__size", "__taken", "__part"]).select(*df.columns)
