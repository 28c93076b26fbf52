"""Every registered query runs on the smallest data and equals its SQL; the rest works without the text subpackage."""

import collections
import datetime
import decimal
import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    con.execute("set timezone = 'UTC'")
    return con


def core_names():
    return [name for plan in entry.PLANS if "llm" not in plan.__name__ for name in plan.QUERIES]


@pytest.mark.parametrize("name", core_names())
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if sql := entry.oracle_sql().get(name):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_text_subpackage():
    for path in glob.glob(f"{ROOT}/tracewell/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
    code = "import sys; sys.modules['tracewell.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p9_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
