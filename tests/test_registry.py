import pytest
from compare import assert_same

from fathomlex.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
