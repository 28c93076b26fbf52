"""Every text query runs on the smallest data."""

import pytest

from tracewell.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    n = df.count()
    assert n > 0 or name == "p9_found"
    assert df.distinct().count() == n
