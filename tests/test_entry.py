"""Driver contract: smoke entry and registry / oracle key agreement."""
import __spark_entry__ as E


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and set(rows[0].asDict()) == {"cindex"}


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 40
