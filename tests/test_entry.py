import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ID", "Pred"]
    assert df.count() > 0


def test_registry_shapes():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) >= 40
    assert set(s) <= set(q)
