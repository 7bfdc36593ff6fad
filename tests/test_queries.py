import pytest
from compare import canonical, duck

import __spark_entry__
from postmill import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    rows = catalog.queries()[name](spark, SF).toPandas()
    assert canonical(rows) == canonical(duck(SF).sql(catalog.oracle_sql()[name]).df())
