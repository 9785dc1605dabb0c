"""Every query that has SQL against DuckDB, on the smallest tables; the others must run and give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from folioweave.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
#: Empty on the smallest tables, not on larger ones.
MAY_BE_EMPTY = {"acyclic_edges", "shared_symbols", "same_statement", "evidence", "term_edges", "contexts", "owners_cards", "scoped_edges", "cycles", "canonical_nodes", "weak_spots", "title_mentions"}


def canonical(rows):
    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted("|".join(text(r[k]) for k in sorted(r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = [r.asDict() for r in catalog.QUERIES[name](spark, FOLDER).collect()]
    if name in catalog.SQL:
        out = duck.sql(catalog.SQL[name])
        want = [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]
        assert canonical(got) == canonical(want)
    assert got or name in MAY_BE_EMPTY


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
