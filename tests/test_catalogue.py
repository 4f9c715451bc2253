import pytest

from sluice.plans import catalogue, oracles


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracles.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_what_its_sql_gives(same, name):
    same(catalogue.QUERIES[name], oracles.ORACLES[name])
