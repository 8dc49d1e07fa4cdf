"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tagloom.plans import queries as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at) for r in rows) if not any(None in r for r in rows) else sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_rows(spark, tables, name):
    found = registered.queries()[name](spark, SF)
    wanted = tables.execute(registered.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows([tuple(r) for r in found.collect()], found.columns) == _rows(wanted.fetchall(), columns)


def test_flagship(spark):
    rows = registered.flagship(spark, SF).collect()
    assert rows and all(len(r["optimal_combination"].split(",")) == 6 and r["start_ability"] not in r["optimal_combination"].split(",") for r in rows)
