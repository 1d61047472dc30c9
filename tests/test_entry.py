"""Every registered query runs on the smallest tables and equals its SQL there."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from compare import SF_DIR, same

from readloom.plans import problem_queries, read_queries, source_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
QUERIES = {**read_queries.QUERIES, **source_queries.QUERIES, **problem_queries.QUERIES}
SQL = {**read_queries.SQL, **source_queries.SQL, **problem_queries.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, expected = same(spark, QUERIES[name], SQL[name])
    assert got == expected


def test_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_import_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "readloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "readloom.llm" not in open(os.path.join(folder, f)).read(), f
