"""Every registered query on the smallest data, beside its SQL.

A spread of queries runs by default; TALKMINE_ALL=1 runs all of them.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from talkmine.plans import QUERIES
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)
#: approximate answers, whose recall ``indexed_recall`` and tests/test_neighbors.py measure
WITHOUT_SQL = {"indexed_neighbors"}
CHOSEN = NAMES if os.environ.get("TALKMINE_ALL") else NAMES[::6]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) is None
    else:
        assert df.columns and df.collect() is not None


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["chunk_id", "video_id"] and not df.isEmpty()


def test_nearly_all_queries_have_sql():
    assert set(oracle_sql()) <= set(queries())
    own = {name for name in queries() if not (name.startswith("op") and name[2:3].isdigit() or name == "pipeline")}
    assert own - WITHOUT_SQL <= set(oracle_sql())
