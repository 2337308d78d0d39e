"""Every registered query of the price engine against its SQL on the small tables."""

import datetime as dt
import math
import os
import sys

import pytest

DATA = os.environ.get("PRICELENS_TEST_DIR", "/root/testdata/sf0.001")
sys.path.append("/opt/oracle")
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(DATA):
    pytest.skip("no test tables", allow_module_level=True)

from pricelens.plans import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)) if not isinstance(x, (int, float)) else "", x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    ours = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in result.fetchall()]
    assert ordered(ours) == ordered(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
