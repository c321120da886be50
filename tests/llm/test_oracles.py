import pytest

from siftline.llm.queries import ORACLES, QUERIES

from ..test_queries import DATA, differences


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, DATA), ORACLES[name]) == []
