import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import registry


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    res = con.execute(registry.ORACLES[name])
    at = [[x[0] for x in res.description].index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in res.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0
