import hashlib
import random
import time

from pyspark.sql import functions as F
from strideframe.llm import merkle


def test_edited_texts(documents):
    rows = [(i * 3, f"Sentence {i}. Another one! " * (i % 5) + "\n\n" + "ü" * i) for i in range(40)]
    found = {r.doc_id: r for r in merkle.compare_with_edits(documents(rows)).collect()}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(t)


def test_roots_test_equality_and_branches_locate_edits(documents):
    a = "One. Two.\nThree.\n\nFour. Five.\nSix."
    b = a.replace("Five", "5")
    rows = documents([(1, a), (2, a), (3, b), (4, None)])
    prints = {r.doc_id: r.fingerprint for r in merkle.fingerprints(rows).collect()}
    assert prints[1] == prints[2] != prints[3]
    assert differ(documents, a, b) == ([[1, 0]], [[1, 0]])
    assert differ(documents, a, a) == ([], [])


def differ(documents, a, b):
    pair = documents([(1, a)]).crossJoin(documents([(2, b)]).select(F.col("text").alias("other")))
    found = pair.select(merkle.differing_branches(merkle.tree(F.col("text")), merkle.tree(F.col("other"))).alias("d")).first().d
    return found.gone, found.came


def test_branches_are_aligned(documents):
    sections = [f"First of {k}.\nSecond, of {k}.\n\n" for k in range(6)]
    whole = "".join(sections)
    assert differ(documents, whole, "New one.\n\n" + whole) == ([], [[0, 0]])
    assert differ(documents, whole, "".join(sections[:3]) + "A new one.\nWith two.\n\n" + "".join(sections[3:])) == ([], [[3, 0], [3, 1]])
    assert differ(documents, whole, "".join(sections[:2] + sections[3:])) == ([[2, 0], [2, 1]], [])
    assert differ(documents, whole, whole.replace("Second, of 4", "2nd, of 4")) == ([[4, 1]], [[4, 1]])
    assert differ(documents, "", whole) == ([], [[k, j] for k in range(6) for j in range(2)]) and differ(documents, "", "") == ([], [])
    assert differ(documents, "same. " * 9, "same. " * 9 + "\n\nmore") == ([[0, 0]], [[0, 0], [1, 0]])


def plain_tree(text):
    """Sections, paragraphs and leaves by a walk over the characters."""
    sections, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text):
            if text[end] == "\n":
                after = end + 1
                while after < len(text) and text[after] in " \t\r":
                    after += 1
                if after < len(text) and text[after] == "\n":
                    end = after + 1
                    while end < len(text) and text[end] in " \t\r\n":
                        end += 1
                    break
            end += 1
        sections.append(text[at:end])
        at = end
    out = []
    for section in sections:
        paragraphs = []
        for c in section:
            if not paragraphs or (paragraphs[-1].endswith("\n") and c != "\n"):
                paragraphs.append("")
            paragraphs[-1] += c
        cut = []
        for p in paragraphs:
            found, leaf = [], ""
            for i, c in enumerate(p):
                leaf += c
                if len(leaf) == merkle.LEAF_CHARS or len(leaf) > 1 and c in ".!?,;:" and p[i + 1 : i + 2].isspace():
                    found.append(leaf)
                    leaf = ""
            cut.append(found + [leaf] * bool(leaf))
        out.append(cut)
    return out


def digest(x, n=64):
    return hashlib.sha256(x.encode()).hexdigest()[:n]


def plain_fingerprint(text):
    found = plain_tree(text)
    nodes = ["".join(digest("".join(digest(x, 32) for x in p)) for p in s) for s in found]
    leaves = [digest(x, 8) for s in found for p in s for x in p]
    return digest("".join(map(digest, nodes))) + ":" + "".join(leaves), set(leaves)


def likeness(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


TEXTS = ["One. Two.\n\nThree.", "One. Two.\n \t\nThree.", "One. Two.\n\r\nThree.", "One. Two.\n\n\nThree.", "\n\n a, b; c\n\n", "", "\n", "word " * 100 + "end. \n\n\n \n tail, it is: so\n", "x" * 500, "no mark\nat all", "ü" * 79 + ". " + "é" * 81 + ", z", "The cat sat, the dog ran. " * 8]


def test_tree_root_and_likeness_against_a_plain_walk(documents):
    rows = [(i + 1, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.p for r in documents(rows).select("doc_id", merkle.pieces(F.col("text")).alias("p")).collect()}
    assert all("".join(x for s in got[i] for p in s for x in p) == t for i, t in rows)
    assert all(len(x) <= merkle.LEAF_CHARS for p in got.values() for s in p for q in s for x in q)
    found = {r.doc_id: r for r in merkle.compare_with_edits(documents(rows)).collect()}
    assert len({r.fingerprint for r in found.values()}) == len(TEXTS)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        (own, leaves), (other, edited_leaves) = plain_fingerprint(t), plain_fingerprint(edited)
        assert got[i] == plain_tree(t), t
        assert (found[i].fingerprint, found[i].edited_fingerprint) == (own, other), t
        assert (found[i].edited_branch is None) == (t == edited)
        if t != edited:  # what comes before it is in both
            s, p = found[i].edited_branch
            before = sum(len(x) for k, section in enumerate(plain_tree(t)) for j, q in enumerate(section) if (k, j) < (s, p) for x in q)
            assert t[:before] == edited[:before]
        assert abs(found[i].near_edited - likeness(leaves, edited_leaves)) < 1e-12 and abs(found[i].near_next - likeness(leaves, plain_fingerprint(after)[1])) < 1e-12


def test_many_blank_lines_and_long_lines(documents):
    rows = [(1, "\n" * 200_000), (2, " \n" * 100_000), (3, "a. " * 100_000), (4, "\n" + " " * 200_000)]
    assert merkle.fingerprints(documents(rows)).where("length(fingerprint) > 64").count() == 4


def test_odd_rows(odd):
    found = merkle.compare_with_edits(odd).collect()
    assert len(found) == odd.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert sum(r.doc_id is None for r in found) == 2
    assert merkle.compare_with_edits(odd.limit(0)).count() == 0
    assert merkle.compare_with_edits(odd.where("doc_id = 4")).first().near_next == 1.0


#: Sections and leaves as they are defined: the shortest of at least one character that is followed by an end.
SHORTEST = r"[\s\S]+?(?:\n[ \t\r]*\n[ \t\r\n]*|\z)", r"[\s\S]{1,79}?(?:[.!?,;:](?=\s)|\z)|[\s\S]{80}"


def test_pieces_of_random_texts(documents):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("ab.,:\n \t\r😀", [rng.choice((1, 5, 60)), 1, *[rng.choice((0.2, 1, 3)) for _ in range(8)]], k=rng.randrange(1, 400)))) for i in range(400)]
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    patterns = (merkle.SECTION, merkle.LEAF, *SHORTEST)
    for r in documents(rows).select("doc_id", merkle.pieces(F.col("text")).alias("p"), F.array(*map(found, patterns)).alias("f")).collect():
        assert r.p == plain_tree(rows[r.doc_id][1]) and r.f[:2] == r.f[2:]


def test_no_end_is_tried_at_each_character(spark):
    """Timed beside the patterns that try it."""
    prose = "The quick brown fox, as was told before, jumps over the lazy dog. It did so twice!\n" * 50
    texts = spark.range(0, 4000, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(prose)).alias("text"))

    def seconds(pattern):
        began = time.perf_counter()
        texts.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).collect()
        return time.perf_counter() - began

    for pattern, shortest in zip((merkle.SECTION, merkle.LEAF), SHORTEST):
        took = [(seconds(pattern), seconds(shortest)) for _ in range(4)]
        assert min(t for t, _ in took) < 0.6 * min(t for _, t in took), took
