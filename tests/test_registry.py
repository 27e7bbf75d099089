"""Every registered query gives its SQL's rows."""

import math

import duckdb
import pytest

from quern import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem part events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    rows = sorted((tuple(value(r[c]) for c in names) for r in got.collect()), key=str)
    other = sorted((tuple(map(value, r)) for r in duck.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({registry.ORACLES[name]})").fetchall()), key=str)
    assert len(rows) == len(other)
    for a, b in zip(rows, other):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(x)) for x, y in zip(a, b)), (a, b)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
