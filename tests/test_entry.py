import __spark_entry__ as driver


def test_every_oracle_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) >= 99


def test_entry_runs(spark):
    df = driver.entry(spark)
    assert df.columns == ["t", "loglik"] and df.count() == 7
