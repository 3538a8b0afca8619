"""Every registered query against DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck

from marketloom import registry

registry.load()
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, SF, name, con)
    if message.startswith("0 rows equal"):  # no rows prove nothing
        ok, message = compare(spark, LARGER, name)
    assert ok, message


def test_every_check_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
