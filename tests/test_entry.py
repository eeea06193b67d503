import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 80
    rows = entry.entry(spark).collect()
    assert len(rows) == 11 and sum(r["n"] for r in rows) == 5954
