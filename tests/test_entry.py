import os

import __spark_entry__ as entry


def test_contract_keys():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 25


def test_entry_smoke(spark):
    if not os.path.isdir(entry.SMOKE_DIR):
        return
    df = entry.entry(spark)
    assert df.count() > 0 and "p95" in df.columns
