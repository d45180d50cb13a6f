import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["group_no", "seed_h", "id", "h", "distance"]
    assert rows and all(r.distance <= 5 for r in rows)


def test_every_query_has_an_oracle_or_is_listed():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 30
