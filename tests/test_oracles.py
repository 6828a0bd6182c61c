"""Every registered query of the engine against its SQL, or for those without SQL, that it runs."""

import pytest

from corvella.plans import registered
from oracle import agree


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, sf_dir, name):
    query, sql = registered()[name]
    if sql:
        agree(spark, sf_dir, query, sql)
    else:
        assert query(spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
