"""Every query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tests.conftest import SMALL
from voxmill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [pytest.approx(x, abs=1e-5) if isinstance(x, float) else x for x in b] == list(a)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
