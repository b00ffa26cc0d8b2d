from pathlib import Path

import pytest

from rankwell.llm.queries import ORACLE_SQL, QUERIES
from verification.compare import connect, difference_of

SF_DIR = "/root/testdata/sf0.001"

#: Held against brute force, a library, exact round trips or held-out labels instead.
WITHOUT_SQL = {
    "op1_token_counts",
    "op2_jaccard_join",
    "op3_nearest",
    "op5_toxicity",
    "op6_quality",
    "op7_sentencepiece",
    "op8_packing",
    "op11_whitening",
}


def test_every_query_has_sql_but_the_listed_ones():
    assert set(QUERIES) - set(ORACLE_SQL) == WITHOUT_SQL
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert difference_of(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLE_SQL[name]) is None
