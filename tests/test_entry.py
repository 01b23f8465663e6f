import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"group_key", "cluster_id", "suggestion", "suggestion_mode", "confidence"} <= set(df.columns)


def test_every_query_has_a_callable():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
