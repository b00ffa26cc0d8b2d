from pathlib import Path

import pytest

import __spark_entry__ as contract
from verification import catalog, oracle
from verification.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
SHORT = ["read_questions", "synonym_chain", "similarity_dispatch", "search_vsm", "search_with_operators", "search_sampled_queries"]


def test_every_query_has_sql():
    assert set(catalog.REGISTRY) == set(oracle.oracle_sql())
    assert set(catalog.REGISTRY) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not here")
@pytest.mark.parametrize("name", SHORT)
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, connect(SF_DIR), SF_DIR, name) is None
