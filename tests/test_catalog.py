import pytest

from codeloom.plans import catalog
from tests.oracle import differences

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, D, catalog.QUERIES[name], catalog.SQL[name]) == ""
