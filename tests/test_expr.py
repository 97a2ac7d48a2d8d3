"""The expression tree, the factor bank, descriptions and the registry."""

import pytest

from tidemark.functions.registry import FactorRegistry, register_factor
from tidemark.plans import describe
from tidemark.plans.expr import Expr, close, corr, ema, log, ma, source, ts_diff, ts_rank, ts_std


def test_equal_expressions_are_one_node():
    a = (close - ma(close, 5)) / ts_std(close, 5)
    assert a == (close - ma(close, 5)) / ts_std(close, 5)
    assert len(list(a.nodes())) == 5


@pytest.mark.parametrize("make", [lambda: source("clsoe"), lambda: Expr("nope"), lambda: ma(close, 0), lambda: Expr("add", (close,)), lambda: Expr("corr", (close,), 5), lambda: Expr("const", value="a"), lambda: ts_diff(close, -1)])
def test_invalid_expressions_raise(make):
    with pytest.raises((ValueError, TypeError)):
        make()


def test_warmup_counts_windows_and_first_counts_bars():
    e = ts_diff(log(close), 30)
    assert (e.warmup(), e.first()) == (30, 31)
    nested = ts_rank(ma(close, 10), 20)
    assert (nested.warmup(), nested.first()) == (30, 29)
    assert corr(close, ema(close, 3), 5).warmup() == 8


def test_bank():
    r = FactorRegistry().load_all()
    assert len(r) == 60 and r.groups() == ["okx_perp"] and "0041" in r and "9999" not in r
    assert len(r.factor_ids_by_group("okx_perp")) == 60
    bank = r.build_all()
    windows = {i: (e.warmup(), e.first()) for (_, i), e in bank.items()}
    assert windows["0041"] == (60, 60) and windows["0033"] == (960, 959) and windows["0057"] == (15, 16) and windows["0018"] == (441, 439)
    with pytest.raises(KeyError):
        r.build("9999")
    with pytest.raises(KeyError):
        r.load_group("none")


def test_registering_twice_raises_and_groups_disambiguate():
    register_factor("test_group", "0041")(lambda: close)
    with pytest.raises(ValueError):
        register_factor("test_group", "0041")(lambda: close)
    r = FactorRegistry().load_group("okx_perp").load_group("test_group")
    with pytest.raises(KeyError):
        r.build("0041")
    assert r.build("0041", "test_group") == close


def test_descriptions(spark):
    e = (close - ma(close, 5)) / 2.0
    rows = describe.describe(spark, e).collect()
    assert [r.op for r in rows] == ["input:close", "ma", "sub", "const", "div"] and rows[-1].is_output
    assert describe.tree(e).splitlines()[0] == "div"
    assert describe.dot(e).count("->") == 5
