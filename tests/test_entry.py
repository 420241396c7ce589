import __spark_entry__


def test_entry_runs(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["vox", "v"]
    assert found.count() == 8192


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
