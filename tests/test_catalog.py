"""Every query of the catalogue against its SQL in DuckDB, on random events."""

import math
import random

import duckdb
import pytest
from strideframe.plans import catalog


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 40), None if i % 97 == 0 else round(rng.expovariate(1 / 20), 2)) for i in range(7000)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, con


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, events, name):
    folder, con = events
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert found
        return
    relation = con.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    assert found == sorted(tuple(_norm(dict(zip(relation.columns, r))[c]) for c in columns) for r in relation.fetchall())
