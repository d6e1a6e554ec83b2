"""Every query against its check statement, and every other query for a stable result."""

import pytest

from ledgerlight.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    outcome, _, _ = compare(spark, name, QUERIES[name], ORACLES[name], sf_dir, duck)
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns
    assert frame.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
