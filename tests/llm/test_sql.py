import pytest

from statlens.llm import queries

from ..parity import duck, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_parity(spark, small, name):
    same(queries.QUERIES[name](spark, small), duck(small), queries.SQL[name])
