"""Driver contract: entry runs; every query has a name; oracles are a subset."""
import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_oracles_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
