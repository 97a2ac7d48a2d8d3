"""The bank over simulated bars, by both executors; long form, latest rows and readiness."""

import numpy as np
import pytest

from tidemark.functions.registry import FactorRegistry
from tidemark.plans import planner
from tidemark.sources.bars import with_returns
from tidemark.sources.simulation import simulate


@pytest.fixture(scope="module")
def bars(spark):
    return with_returns(simulate(spark, ["BTC-USDT-SWAP", "X"], 700, seed=5).withColumnRenamed("vol", "volume")).cache()


@pytest.fixture(scope="module")
def bank():
    return {f"f_{k}": e for k, e in FactorRegistry().load_group("okx_perp").build_group("okx_perp").items()}


def test_both_executors_agree(bars, bank):
    some = {k: bank[k] for k in ("f_0001", "f_0011", "f_0029", "f_0039", "f_0042", "f_0055", "f_0063", "f_0038")}
    a, b = (planner.compute(bars, some, raw=True, strategy=s).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True) for s in ("native", "arrow"))
    for k in some:
        x, y = a[k].to_numpy(float), b[k].to_numpy(float)
        assert (np.isnan(x) == np.isnan(y)).all(), k
        assert np.allclose(x, y, rtol=1e-6, atol=1e-8, equal_nan=True), k


def test_first_values_come_where_expected(bars, bank):
    got = planner.compute(bars, bank, raw=True).where("symbol = 'X'").toPandas().sort_values("seq")
    for k, e in bank.items():
        seen = np.flatnonzero(got[k].notna().to_numpy())
        if e.first() <= 700:
            assert len(seen) and seen[0] + 1 >= e.first(), k
        else:
            assert not len(seen), k


def test_forms(bars, bank):
    some = {k: bank[k] for k in ("f_0041", "f_0063")}
    wide = planner.compute(bars, some, ready=True)
    assert {"f_0041_ready", "f_0063_ready"} <= set(wide.columns)
    assert planner.long_form(wide, list(some)).count() == 2 * 1400
    last = planner.latest(wide).toPandas()
    assert sorted(last["seq"]) == [699, 699]


def test_symbols_don_t_depend_on_each_other(bars, bank):
    some = {"v": bank["f_0035"]}
    both = planner.compute(bars, some).where("symbol = 'X'").toPandas().sort_values("seq")["v"]
    alone = planner.compute(bars.where("symbol = 'X'"), some).toPandas().sort_values("seq")["v"]
    assert np.array_equal(both, alone)


@pytest.mark.parametrize("strategy", ["native", "arrow"])
@pytest.mark.parametrize("rows", [50, 333, 10_000])
def test_slices_equal_the_whole(bars, bank, strategy, rows):
    some = {k: bank[k] for k in ("f_0001", "f_0039", "f_0057", "f_0064")} | ({"f_0059": bank["f_0059"]} if strategy == "arrow" else {})
    whole, cut = (planner.compute(bars, some, raw=True, strategy=strategy, slice_rows=s).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True) for s in (None, rows))
    assert len(cut) == len(whole) and cut["seq"].tolist() == whole["seq"].tolist()
    for k in some:
        assert np.allclose(whole[k].to_numpy(float), cut[k].to_numpy(float), rtol=1e-6, atol=1e-8, equal_nan=True), k


def test_single_precision(bars, bank):
    some = {k: bank[k] for k in ("f_0041", "f_0035", "f_0051")}
    one, two = (planner.compute(bars, some, precision=p).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True) for p in ("single", "double"))
    for k in some:
        x = one[k].to_numpy()
        assert np.array_equal(x, x.astype(np.float32).astype(float)) and np.allclose(x, two[k], rtol=5e-2, atol=5e-2)
    for bad in ({"precision": "half"}, {"precision": "single", "strategy": "native"}):
        with pytest.raises(ValueError):
            planner.compute(bars, some, **bad)


def test_choice():
    """Shifts and a few short light frames stay with Spark; long, costly and many ones go to the kernels."""
    from tidemark.plans import expr as X

    assert planner.choose({"v": X.ts_zscore(X.delay(X.x, 500), 30)}) == "native"
    for e in (X.ma(X.x, 240), X.ts_rank(X.x, 30), X.corr(X.x, X.y, 5), X.ema(X.x, 3)):
        assert planner.choose({"v": e}) == "arrow"


def test_long_series_are_cut(bars, bank, monkeypatch):
    """Beyond the estimate, keys' rows are counted, and long series are cut without a word from the caller."""
    some = {"f_0001": bank["f_0001"]}
    whole = planner.compute(bars, some, raw=True, slice_rows=0).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    monkeypatch.setattr(planner, "BIG", 0)
    assert planner.slices(bars, ["symbol"]) == 0
    monkeypatch.setattr(planner, "SLICE_ROWS", 50)
    assert planner.slices(bars, ["symbol"]) == 50
    cut = planner.compute(bars, some, raw=True).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    np.testing.assert_allclose(whole["f_0001"], cut["f_0001"], rtol=1e-9)
