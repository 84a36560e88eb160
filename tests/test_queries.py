"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracles import compare, oracle_session

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle_session(FOLDER)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, connection, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    oracle = entry_points.oracle_sql().get(name)
    if oracle is None:
        assert frame.count() > 0
        return
    verdict = compare(frame, connection.sql(oracle))
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_oracles_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["position", "aminoacid"]
