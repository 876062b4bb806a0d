"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from ethoflow.catalog import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(int(v)) if isinstance(v, (int, bool)) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    got = [tuple(r.values()) for r in df.toArrow().to_pylist()]
    con = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = plain(got, df.columns), plain(want, names)
    assert len(a) == len(b) and [x for x, y in zip(a, b) if x != y and not any(_close(i, j) is False for i, j in zip(x, y))] == [] and all(_close(i, j) for x, y in zip(a, b) for i, j in zip(x, y))


def _close(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_query_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
