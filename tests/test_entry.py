"""The driver's contract: every query runs on the small tables, and equals its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["operator_ts_rank", "operator_ema", "operator_corr", "factor_0041", "factor_0018", "bars_time", "tick_snapshot", "book_snapshot", "factor_bank", "factor_0044", "native_corr", "describe_factor", "cross_section", "candles_parsed", "latest_factor", "factor_readiness"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(k.startswith("factor_0") for k in entry.queries()) == 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    a, b = entry.queries()[name](spark, DATA).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    keys = [k for k in columns if a[k].dtype.kind != "f"]
    a, b = (x[columns].sort_values(keys).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for k in columns:
        assert ((a[k] == b[k]) | (a[k].isna() & b[k].isna())).all(), k


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
