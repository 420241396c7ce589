"""Corpus queries against their SQL on the same tables."""

import pytest

from lumivox.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", [x for x in ORACLE_SQL if x != "op1_substring_dedup"])
def test_query_matches_sql(spark, data, duck, same_rows, name):
    same_rows(QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).df())
