"""Every registered query of the trace operators against its SQL, and the driver's contract."""

import pytest

import __spark_entry__
from stepline.plans import registry, source_queries, spec_queries, trace_queries  # noqa: F401

from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    n = compare(registry.QUERIES[name](spark, sf), registry.ORACLES[name], con)
    if not n:
        # the smallest tables leave no row: the next larger ones must
        large = sf.replace("sf0.001", "sf0.01")
        n = compare(registry.QUERIES[name](spark, large), registry.ORACLES[name], connect(large))
    assert n > 0


def test_gaps_between_versions_are_found(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1)], "capture_id int, version int")
    from stepline.operators import rounds

    assert [(r.capture_id, r.version) for r in rounds.version_check(df).collect()] == [(1, 4)]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_a_callable():
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
