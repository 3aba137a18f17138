"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillon import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(getattr(value, "isoformat", lambda: value)())[:26].removesuffix("+00:00")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    frame = catalog.QUERIES[name](spark, str(DATA))
    found = db.sql(catalog.ORACLE_SQL[name])
    names = sorted(frame.columns)
    assert sorted(found.columns) == names
    want = sorted([plain(row[found.columns.index(c)]) for c in names] for row in found.fetchall())
    assert sorted([plain(r[c]) for c in names] for r in frame.collect()) == want
