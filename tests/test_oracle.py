"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import oracle_check
import pytest

import __spark_entry__ as entry_points
from furrow.plans import oracles, registry

QUERIES = registry.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle_check.connect(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["plot_id", "window_end", "alert_type", "severity", "message"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert oracle_check.differences(duck, ORACLES[name], QUERIES[name](spark, sf_dir)) == []
