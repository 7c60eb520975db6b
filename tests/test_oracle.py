"""Every query with oracle SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from quillgraph.plans import registry
from quillgraph.plans.views import STAR

from .conftest import SF

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in STAR:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(str([show(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLES[name])
    assert got == canon(rel.columns, rel.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
