"""Reports and rankings beside DuckDB on the smallest tables, and published numbers."""

import duckdb
import pytest

from graphloom.plans import reports

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(round(r[k], 7) if isinstance(r[k], float) else r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(reports.QUERIES))
def test_equals_duckdb(spark, duck, name):
    got = reports.QUERIES[name](spark, DIR)
    want = duck.execute(reports.ORACLES[name])
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())
