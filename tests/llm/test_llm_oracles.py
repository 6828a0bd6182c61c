import pytest

from corvella.llm.queries import ORACLE_SQL, QUERIES
from oracle import agree


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    agree(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])
