"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, rows  # noqa: E402
from tickloom.plans import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE

# at this scale no series is long enough, or every folder is empty
MAY_BE_EMPTY = {"p5_drop_incomplete", "p7_drop_sparse", "p8_fill_sparse", "j1_align", "a7_corr_matrix", "x4_dca",
                "x4_dca_purchases", "m1_pca_tickers", "m7_pick_reduction"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    df = QUERIES[name](spark, SF)
    columns, got = df.columns, [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert got or name in MAY_BE_EMPTY
        return
    answer = duck.execute(ORACLE[name])
    names = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(names)
    expected = rows(names, answer.fetchall())
    assert rows(columns, got) == expected
    assert expected or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
