"""The queries that SQL can express, against DuckDB on the smallest tables."""

import pytest

from quillon.llm import queries
from tests.test_oracle import DATA, db, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):  # noqa: F811
    frame, found = queries.QUERIES[name](spark, str(DATA)), db.sql(queries.ORACLE_SQL[name])
    names = sorted(frame.columns)
    assert sorted(found.columns) == names
    want = sorted([plain(row[found.columns.index(c)]) for c in names] for row in found.fetchall())
    assert sorted([plain(r[c]) for c in names] for r in frame.collect()) == want
