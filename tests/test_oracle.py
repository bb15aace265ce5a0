"""Every registered query against its SQL."""

import pytest

from checks import registry
from checks.compare import compare, duck

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
