"""Every query with SQL against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemill.plans import warehouse

DATA = "/root/testdata/sf0.001"
SQL = warehouse.oracle_sql()


def same(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(warehouse.queries()))
def test_query(spark, name):
    got = warehouse.queries()[name](spark, DATA)
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: [(v is None, v) for v in r]
    rows = sorted((tuple(map(same, r)) for r in want.fetchall()), key=key)
    assert rows
    assert sorted((tuple(map(same, r)) for r in got.select(*names).collect()), key=key) == rows
