import pytest

import __spark_entry__ as entry
from tests.compare import difference

SF = "/root/testdata/sf0.001"
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    elif name in ("search_filtered",):
        assert difference(spark, query, sql, SF) in ("", "no rows")
    else:
        assert difference(spark, query, sql, SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
