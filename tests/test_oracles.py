import pytest
from oracle import duck_rows, spark_rows

from mesoflow.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = spark_rows(registry.queries()[name](spark, sf_dir)), duck_rows(ORACLES[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())
