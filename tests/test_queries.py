"""Every query of the library's own operators against its SQL."""

import pytest

from lumivox.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, data, duck, same_rows, name):
    found = QUERIES[name](spark, data)
    assert set(found.columns) == set(duck.execute(ORACLE_SQL[name]).df().columns)
    key = lambda frame: frame.sort_values(sorted(frame.columns)).reset_index(drop=True)[sorted(frame.columns)]
    ours, theirs = key(found.toPandas()), key(duck.execute(ORACLE_SQL[name]).df())
    assert len(ours) == len(theirs)
    for column in ours:
        assert ((ours[column] == theirs[column]) | (ours[column].isna() & theirs[column].isna())).all(), column


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
