"""Operator 8: document fingerprints as Merkle trees over sections, paragraphs and sentences.

A section goes up to and with the blank lines after it, a paragraph up to and with its
line ends, and a paragraph's leaves are its clauses and sentences, cut at LEAF_CHARS
where none ends. Separators stay in the leaves, which joined give back the text: texts
that differ have different roots. A node is the SHA-256 of its children's digests, so a
walk down the branches that differ finds an edit. All of it is DataFrame functions.

Defined cases: a null text is an empty one; two texts without leaves in common have
likeness 0, two empty ones 1; very long texts are fingerprinted whole; rows that share a
doc_id are one place in the order, and of their texts the least stands for the next
document; a row without doc_id has no next document; an empty table gives an empty result; a
column named as the fingerprint gives way to it, all others may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAF_CHARS = 80
#: Each character of what they are applied to is in one match. Matches go ahead by loops over classes; to try at
#: each character whether one ends there takes several times as long.
SECTION = r"(?s:.)[^\n]*(?:\n(?![ \t\r]*\n)[^\n]*)*+(?:\n[ \t\r]*\n[ \t\r\n]*)?"
PARAGRAPH = r"[^\n]+\n*|\n+"
MARK = ".!?,;:"
#: A character, then those that end no leaf, and the next one. The first branch is for leaves without marks within, as most are.
LEAF = (
    rf"(?s:.)[^{MARK}]{{0,{LEAF_CHARS - 2}}}+(?:[{MARK}](?=\s)|[^{MARK}]|\z)"
    rf"|(?s:.)(?:[^{MARK}]|[{MARK}](?!\s)){{0,{LEAF_CHARS - 2}}}+(?s:.)?"
)
#: Hex digits of a leaf's digest, and of those that a fingerprint holds.
DIGEST, SHORT = 32, 8
#: doc_ids are above this; rows without one get numbers from here down.
NUMBERED = -(1 << 62)


def pieces(text: Column) -> Column:
    """Sections, each an array of paragraphs, each an array of its leaves."""
    parts = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.transform(parts(text, SECTION), lambda s: F.transform(parts(s, PARAGRAPH), lambda p: parts(p, LEAF)))


def tree(text: Column) -> Column:
    """The same with the leaves' digests."""
    digests = lambda leaves_: F.transform(leaves_, lambda x: F.left(F.sha2(x, 256), F.lit(DIGEST)))
    return F.transform(pieces(text), lambda s: F.transform(s, digests))


def node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def section_nodes(sections: Column) -> Column:
    return F.transform(sections, lambda s: node(F.transform(s, node)))


def leaves(sections: Column) -> Column:
    """Short digests of a tree's leaves, in order."""
    return F.transform(F.flatten(F.flatten(sections)), lambda d: F.left(d, F.lit(SHORT)))


def fingerprint(sections: Column) -> Column:
    """The root, then the leaves' short digests."""
    return F.concat(node(section_nodes(sections)), F.lit(":"), F.array_join(leaves(sections), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of leaf digests as sets."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(2.0 * both / all_)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _agreeing(x: Column, y: Column, most: Column, at_end: bool = False) -> Column:
    """How many of the first (or last) ``most`` digests of two arrays are the same."""
    of = lambda a, i: F.get(a, F.size(a) - 1 - i if at_end else i)
    apart = F.filter(F.sequence(F.lit(0), most - 1), lambda i: of(x, i) != of(y, i))
    return F.when(most > 0, F.coalesce(F.get(apart, F.lit(0)), most)).otherwise(0)


def _between(x: Column, y: Column, fn: Callable[[Column, Column, Column], Column]) -> Column:
    """``fn`` of where two arrays of digests begin to differ and how many of each lie between what they have in common at both ends."""
    shorter = F.least(F.size(x), F.size(y))
    ends = lambda begin: F.struct(begin.alias("begin"), _agreeing(x, y, shorter - begin, at_end=True).alias("end"))
    return _let(_let(_agreeing(x, y, shorter), ends), lambda e: fn(e["begin"], F.size(x) - e["begin"] - e["end"], F.size(y) - e["begin"] - e["end"]))


def differing_branches(a: Column, b: Column) -> Column:
    """Where two trees differ: the branches of the first that are gone and those of the second that came, as [section, paragraph] numbers from 0.

    The walk goes down from the roots: sections whose nodes agree, from the beginning and
    from the end, are left alone, and so are the paragraphs of those between. An inserted
    section is what came, and moves none of those after it.
    """

    def below(begin: Column, n_a: Column, n_b: Column) -> Column:
        some = F.struct(F.slice(a, begin + 1, n_a).alias("a"), F.slice(b, begin + 1, n_b).alias("b"), begin.alias("begin"))
        digests = lambda sections: F.flatten(F.transform(sections, lambda s: F.transform(s, node)))
        places = lambda sections, first: F.flatten(F.transform(sections, lambda s, i: F.transform(F.sequence(F.lit(1), F.size(s)), lambda j: F.array(first + i, j - 1))))
        flat = lambda p: F.struct(digests(p["a"]).alias("x"), digests(p["b"]).alias("y"), places(p["a"], p["begin"]).alias("at_x"), places(p["b"], p["begin"]).alias("at_y"))
        told = lambda q: _between(q["x"], q["y"], lambda first, n_x, n_y: F.struct(F.slice(q["at_x"], first + 1, n_x).alias("gone"), F.slice(q["at_y"], first + 1, n_y).alias("came")))
        return _let(_let(some, flat), told)

    return _let(F.struct(section_nodes(a).alias("x"), section_nodes(b).alias("y")), lambda p: _between(p["x"], p["y"], below))


def fingerprints(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text``; a column named ``output`` gives way to it."""
    return df.withColumn(output, fingerprint(tree(F.coalesce(F.col(text), F.lit("")))))


def followers(documents: DataFrame) -> DataFrame:
    """For each numbered doc_id that another precedes in ascending order (the last precedes the first): the one before, and its half's length.

    The order is dealt to ranges, so that no task sees all ids; only the ranges' first and last ids meet in one place.
    """
    half = F.max(F.floor(F.length("text") / 2)).cast("int")
    ids = documents.groupBy("doc_id").agg(half.alias("half"))
    # Told by the half, not by the id: a condition on the id would reach one use of the texts and part it from the other.
    ids = ids.withColumn("half", F.when(F.col("doc_id") > NUMBERED, F.col("half")).otherwise(-1)).where("half >= 0")
    dealt = cut(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    last = dealt.groupBy("range").agg(F.max(F.struct("doc_id", "half")).alias("last"))
    ranges = Window.orderBy("range")
    before = F.coalesce(F.lag("last").over(ranges), F.max("last").over(Window.partitionBy()))
    edges = last.select("range", before.alias("before"))
    within = F.lag(F.struct("doc_id", "half")).over(Window.partitionBy("range").orderBy("doc_id"))
    return (
        dealt.join(edges, "range")
        .withColumn("previous", F.coalesce(within, F.col("before")))
        .select("doc_id", F.col("previous.doc_id").alias("previous_id"), F.col("previous.half").alias("previous_half"))
    )


def compare_with_edits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's fingerprint beside that of its edited text, whose second half is the next document's beginning, and the first branch in which their trees differ (null if in none).

    A document goes out twice: to the join that completes it, and as a beginning to the document before it.
    """
    # Without nulls among the keys both joins read one and the same exchange of the texts.
    nameless = F.lit(NUMBERED) - F.shiftrightunsigned(F.xxhash64(F.col(text)), 2)
    documents = df.select(F.coalesce(F.col(key).cast("long"), nameless).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent = (
        documents.join(followers(documents), "doc_id")
        .select(
            F.col("previous_id").alias("doc_id"),
            F.struct(F.left("text", F.col("previous_half")).alias("beginning"), leaves(tree(F.col("text"))).alias("leaves")).alias("next"),
        )
        .groupBy("doc_id")
        .agg(F.min("next").alias("next"))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next.beginning", F.lit("")), half))
    trees = (
        documents.join(sent, "doc_id", "left")
        .select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.leaves").alias("next_leaves"))
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_leaves", tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("other"))
    )
    own, other = F.col("own_leaves"), F.col("other_leaves")
    trees = trees.withColumn("edit", differing_branches(F.col("own"), F.col("other")))
    return trees.withColumn("own_leaves", leaves(F.col("own"))).withColumn("other_leaves", leaves(F.col("other"))).select(
        F.when(F.col("doc_id") > NUMBERED, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        F.coalesce(likeness(own, F.col("next_leaves")), F.lit(0.0)).alias("near_next"),
        F.coalesce(F.get(F.col("edit.gone"), F.lit(0)), F.get(F.col("edit.came"), F.lit(0))).alias("edited_branch"),
    )
