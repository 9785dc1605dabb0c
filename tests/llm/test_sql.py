"""The queries that have SQL against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from folioweave.llm import exchange as ex
from folioweave.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, monkeypatch, name):
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, str(FOLDER))
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r) for r in want.select(*order).fetchall())
