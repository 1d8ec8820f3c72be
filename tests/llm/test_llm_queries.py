import pytest

import __spark_entry__ as entry
from ledgerloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry_lists_them():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
