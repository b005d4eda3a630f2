"""Every query against its SQL."""

import pytest

from tests.conftest import SF_DIR
from timbrewatch.catalog.oracles import ORACLES
from timbrewatch.catalog.queries import QUERIES


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got and got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
