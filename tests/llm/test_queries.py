"""The queries that SQL can express, against DuckDB, over small tables with odd rows."""

import random

import duckdb
import pytest
from strideframe.llm import queries


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("llm_tables"))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["#", "ü漢", "\U0001f600", "a|b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))).replace("w1 ", "\n") for _ in range(150)] + ["", None, "\n \n", "so so " * 60]
    sources = ["a", "B", "ä", "z", None, "tiny"]
    documents([(i * 3 % 1000 + i, t, rng.choices(sources, [9, 3, 2, 1, 1, 0.2])[0]) for i, t in enumerate(texts)]).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    html = [None, "", "short", "<p>x</p>" * 40, "<p>ü</p>" * 40]
    spark.createDataFrame([(i, f"http://x/{i}", html[i % 5]) for i in range(60)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    roles = ["system", "user", "assistant", "tool", "other", None]
    turns = [(c, t, rng.choice(roles) if c % 3 else roles[1 + t % 2], rng.choice([*texts[:9], "<|im_end|>", "<\\\\|im_start|>\n", None])) for c in range(40) for t in range(c % 6 + 1)]
    spark.createDataFrame([*turns, (3, 1, "user", "twice")], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    embedded = [(i, None if i % 41 == 0 else [rng.gauss(0, 0.125) for _ in range(64)] if i % 5 else [0.125] * 63 + [float("nan") if i % 35 == 0 else 0.25], rng.choice([None, *range(10)])) for i in range(420)]
    spark.createDataFrame(embedded, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, tables, name):
    folder, con = tables
    df, relation = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert found == sorted((tuple(dict(zip(relation.columns, r))[c] for c in columns) for r in relation.fetchall()), key=repr)
