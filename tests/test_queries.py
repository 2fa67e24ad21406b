import pytest

import __spark_entry__ as entry
from matchpulse.plans.oracle import oracle_sql
from matchpulse.plans.queries import REGISTRY
from tests.compare import compare


def test_every_query_has_an_oracle():
    assert set(REGISTRY) == set(oracle_sql())
    assert set(REGISTRY) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", REGISTRY)
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) is None
