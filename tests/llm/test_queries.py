import pytest

from sluice.llm import oracles, queries

FROM_SQL = sorted(oracles.ORACLES)


@pytest.mark.parametrize("name", FROM_SQL)
def test_query_gives_what_its_sql_gives(same, name):
    same(queries.QUERIES[name], oracles.ORACLES[name])


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
