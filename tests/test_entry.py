import __spark_entry__ as e


def test_contract(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["event_id", "pointer", "k"] and df.count() > 0
