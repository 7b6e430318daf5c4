"""Every query of the library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import graph_queries, numeric_queries, run_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {**graph_queries.REGISTRY.sql, **numeric_queries.REGISTRY.sql, **run_queries.REGISTRY.sql}
QUERIES = {**graph_queries.REGISTRY.queries, **numeric_queries.REGISTRY.queries, **run_queries.REGISTRY.queries}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def key(row):
    return tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(key(r) for r in got.select(*(f"`{n}`" for n in names)).collect()) == sorted(key([r[i] for i in order]) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql(spark):
    assert QUERIES["ba_graph"](spark, SF).count() == 5988
    assert QUERIES["rf_metrics"](spark, SF).first().accuracy > 0.3
