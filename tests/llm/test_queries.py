import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from compare import SF_DIR, same

from readloom.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got, expected = same(spark, queries.QUERIES[name], queries.SQL[name])
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert rows and len(set(map(repr, rows))) == len(rows)
