"""Every core query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from strataq.queries import ORACLE_SQL, QUERIES
from strataq.session import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    r = duck.execute(ORACLE_SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = r.fetchall()
    order = sorted(cols)
    a = sorted((tuple(norm(x[k]) for k in order) for x in got), key=repr)
    b = sorted((tuple(norm(x[cols.index(k)]) for k in order) for x in want), key=repr)
    assert a == b
