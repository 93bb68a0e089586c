import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text) or (doc_id, text, source) to a table of documents."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Texts that every operator must take.
ODD_TEXTS = [None, "", " \n\t ", "word", "ein Wörtchen übergroß 漢字 \U0001f600", "x" * 30_000, "long words " * 4000, "a\n\nb. c! d?\n\n\ne"]


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in all columns, empty and very long texts, repeated rows, and columns that clash with results."""
    from pyspark.sql import functions as F

    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[3], (None, "no number here at all"), (None, None, None)]
    clash = ["n_tokens", "SIMHASH", "kept", "score", "size", "taken", "fingerprint", "n_words", "token_ids", "license_family", "cell", "block"]
    return documents(rows).select("*", *[F.lit("own").alias(c) for c in clash])
