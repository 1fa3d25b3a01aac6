import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 100 and {r.status for r in rows} == {"answered", "partial", "abstained"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
