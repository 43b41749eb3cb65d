"""Every query against its SQL twin on the smallest tables."""

import pytest

from check_oracle import connect, differences
from workload import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, sf, name):
    assert differences(spark, con, name, sf) is None


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
