import pytest
from cases import SF_DIR
from compare import difference, duckdb_with

from foliospark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), duckdb_with(SF_DIR), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
