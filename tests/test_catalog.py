"""Every registered query against its SQL form over the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from scribemill.catalog.oracles import ORACLES
from scribemill.catalog.queries import QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["doc_id", "source", "text"]
    assert df.limit(1).count() == 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    same, message = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert same, message
