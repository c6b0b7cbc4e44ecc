"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from keelson import catalog_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog_queries.queries(), catalog_queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    result = tables.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_data_codes_occur(spark):
    codes = {r.code for r in catalog_queries.commit_all_codes(spark, SF).collect()}
    assert codes == {"INT-003", "INT-004", "INT-005", "INT-006", "INT-007"}
