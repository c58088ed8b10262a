"""Every registered query against its SQL, at the smallest scale."""

import pytest

from checks import compare, oracles, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(queries.registry()) == set(oracles.registry())


@pytest.mark.parametrize("name", queries.registry())
def test_matches_sql(spark, con, name):
    assert compare.compare(spark, con, name, SMALL) == ""
