import pytest
from check import compare, duck

from tickloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark):
    _, error = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])
    assert error is None, error
