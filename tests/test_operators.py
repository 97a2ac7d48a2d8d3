"""Every operator against a plain per-window version, by both executors, on the edge cases."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import arrow
from tidemark.plans import planner
from tidemark.plans import expr as X
from tidemark.plans.slicing import lookback

NAN = float("nan")

EPS = 1e-8
T = 5


def window(v, i, t):
    return v[max(0, i - t + 1) : i + 1]


def full(f, least=None):
    def run(v, i, t):
        w = [a for a in window(v, i, t) if a is not None]
        return f(w) if len(w) >= (t if least is None else least(t)) and (least is not None or i >= t - 1) else None

    return run


def skew(w):
    n, m = len(w), sum(w) / len(w)
    s2 = sum((a - m) ** 2 for a in w)
    return 0.0 if s2 == 0 else (sum((a - m) ** 3 for a in w) / n) / (s2 / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)


def kurt(w):
    n, m = len(w), sum(w) / len(w)
    s2 = sum((a - m) ** 2 for a in w) / n
    return None if s2 == 0 else ((n + 1) * (sum((a - m) ** 4 for a in w) / n / s2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))


def div(a, b):
    return None if a is None or b is None else a / b if b else math.inf if a > 0 else -math.inf if a < 0 else None


def at(v, i, t):
    return v[i - t] if i >= t else None


def zscore(v, i, t):
    s = full(statistics.pstdev)(v, i, t)
    return None if s is None or s < EPS else (v[i] - full(statistics.fmean)(v, i, t)) / (s + EPS)


def least(t):
    return max(2, t // 2)


def mad(v, i, t):
    away = [None if a is None or (m := full(statistics.median, least)(v, k, t)) is None else abs(a - m) for k, a in enumerate(v)]
    return full(statistics.median, least)(away, i, t)


def pearson(x, y, i, t):
    p = [(a, b) for a, b in zip(window(x, i, t), window(y, i, t), strict=True) if a is not None and b is not None]
    if len(p) < t:
        return None
    a, b = zip(*p, strict=True)
    s = statistics.pstdev(a) * statistics.pstdev(b)
    return None if not s else statistics.fmean([(q - statistics.fmean(a)) * (r - statistics.fmean(b)) for q, r in p]) / s


def covariance(x, y, i, t):
    p = [(a, b) for a, b in zip(window(x, i, t), window(y, i, t), strict=True) if a is not None and b is not None]
    if len(p) < t:
        return None
    a, b = zip(*p, strict=True)
    return sum((q - statistics.fmean(a)) * (r - statistics.fmean(b)) for q, r in p) / (t - 1)


def shifted(v, n):
    return [at(v, i, n) for i in range(len(v))]


def double(v, i, t):
    def gap(u):
        return [None if a is None or (m := full(statistics.fmean)(u, k, t)) is None else a - m for k, a in enumerate(u)]

    old = shifted(v, 2)
    top = full(statistics.fmean)([None if a is None or b is None else a * b for a, b in zip(gap(v), gap(old), strict=True)], i, t)
    a, b = full(statistics.stdev)(v, i, t), full(statistics.stdev)(old, i, t)
    return None if top is None or not a or not b else top / (a * b)


def ema(v, i, t):
    run = []
    for a in v[: i + 1]:
        run = [] if a is None else [*run, a]
    if len(run) < t:
        return None
    out = run[0]
    for a in run[1:]:
        out += 2 / (t + 1) * (a - out)
    return out


def some(f):
    def run(v, i, t):
        w = [a for a in window(v, i, t) if a is not None]
        return f(w) if w else None

    return run


def rank(w):
    return (sum(a < w[-1] for a in w) + (sum(a == w[-1] for a in w) + 1) / 2) / len(w)


PLAIN = {
    "ma": full(statistics.fmean), "ts_sum": full(sum), "ts_std": full(statistics.pstdev), "ts_vari": full(statistics.pvariance), "ts_min": full(min), "ts_max": full(max), "ts_rank": full(rank), "ts_zscore": zscore,
    "delay": at, "ts_diff": lambda v, i, t: None if v[i] is None or at(v, i, t) is None else v[i] - at(v, i, t),
    "ts_pct": lambda v, i, t: None if (q := div(v[i], None if at(v, i, t) is None else at(v, i, t) + EPS)) is None else q - 1,
    "ts_minmax_diff": some(lambda w: max(w) - min(w)), "ts_max_diff": lambda v, i, t: None if v[i] is None else v[i] - some(max)(v, i, t), "ts_min_diff": lambda v, i, t: None if v[i] is None else v[i] - some(min)(v, i, t),
    "ts_skew": full(skew), "ts_kurt": full(kurt), "ts_med": full(statistics.median), "ts_mad": mad, "ts_mad_window": full(lambda w: statistics.median([abs(a - statistics.median(w)) for a in w]), least),
    "ts_wma": full(lambda w: sum((k + 1) * a for k, a in enumerate(w)) / (len(w) * (len(w) + 1) / 2)), "ts_ir": full(lambda w: statistics.fmean(w) / (statistics.stdev(w) + EPS), least), "ema": ema,
}


def series():
    rng = np.random.default_rng(3)
    normal = rng.normal(size=40).tolist()
    gaps = [None if rng.random() < 0.1 else a for a in rng.normal(size=40).tolist()]
    ties = [float(a) for a in rng.integers(0, 3, 40)]
    return {"normal": normal, "gaps": gaps, "ties": ties, "none": [None] * 12, "constant": [2.5] * 12, "zeros": [0.0] * 12, "one": [3.14], "up": [float(k) for k in range(12)], "large": [1e30 if k == 5 else -1e-38 if k == 7 else float(k) for k in range(20)]}


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for s, v in series().items():
        rows += [(s, k, k, a, None if a is None else a * a - k) for k, a in enumerate(v)]
    rng = np.random.default_rng(1)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    return spark.createDataFrame(rows, "symbol string, ts long, seq long, x double, y double").repartition(3).cache()


def values(table, e, strategy):
    got = planner.compute(table, {"v": e}, raw=True, strategy=strategy).toPandas().sort_values(["symbol", "seq"])
    return {s: [None if pd.isna(a) else a for a in g["v"]] for s, g in got.groupby("symbol")}


def check(got, expected, skip=()):
    for s, want in expected.items():
        if s in skip:
            continue
        for i, (a, b) in enumerate(zip(got[s], want, strict=True)):
            assert (a is None) == (b is None), (s, i, a, b)
            assert a is None or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9), (s, i, a, b)


@pytest.mark.parametrize("strategy", ["native", "arrow"])
@pytest.mark.parametrize("op", sorted(PLAIN))
def test_rolling(table, op, strategy):
    if op == "ema" and strategy == "native":
        with pytest.raises(ValueError):
            planner.compute(table, {"v": X.ema(X.x, T)}, strategy="native")
        return
    got = values(table, X.Expr(op, (X.x,), T), strategy)
    skip = {"large"} if op in ("ts_skew", "ts_kurt", "ts_zscore", "ts_ir", "ts_std", "ts_vari", "ts_sum", "ma", "ts_wma", "ts_mad", "ts_mad_window") else set()
    check(got, {s: [PLAIN[op](v, i, T) for i in range(len(v))] for s, v in series().items()}, skip)


@pytest.mark.parametrize("strategy", ["native", "arrow"])
@pytest.mark.parametrize("t", [1, 2, 40, 41])
def test_windows(table, t, strategy):
    for op in ("ma", "ts_max", "ts_sum", "ts_minmax_diff"):
        got = values(table, X.Expr(op, (X.x,), t), strategy)
        check(got, {s: [PLAIN[op](v, i, t) for i in range(len(v))] for s, v in series().items()}, {"large"})
    zero = values(table, X.ts_rank(X.x, 1), strategy)
    assert zero["normal"] == [0.0] * 40
    assert set(values(table, X.ts_rank(X.x, 0), strategy)["normal"]) == {None}


@pytest.mark.parametrize("strategy", ["native", "arrow"])
def test_pairs(table, strategy):
    s = series()
    y = {k: [None if a is None else a * a - i for i, a in enumerate(v)] for k, v in s.items()}
    check(values(table, X.corr(X.x, X.y, T), strategy), {k: [pearson(v, y[k], i, T) for i in range(len(v))] for k, v in s.items()}, {"large"})
    check(values(table, X.cov(X.x, X.y, T), strategy), {k: [covariance(v, y[k], i, T) for i in range(len(v))] for k, v in s.items()}, {"large"})
    check(values(table, X.autocorr(X.x, T, 2), strategy), {k: [pearson(v, shifted(v, 2), i, T) for i in range(len(v))] for k, v in s.items()}, {"large", "up"})
    check(values(table, X.autocorr_double(X.x, T, 2), strategy), {k: [double(v, i, T) for i in range(len(v))] for k, v in s.items()}, {"large"})
    assert set(values(table, X.autocorr(X.x, 1, 2), strategy)["normal"]) == {None}
    same = values(table, X.corr(X.x, X.x, T), strategy)["normal"][T:]
    assert all(math.isclose(a, 1.0, rel_tol=1e-9) for a in same)
    assert set(values(table, X.corr(X.x, X.x, T), strategy)["constant"]) == {None}


@pytest.mark.parametrize("strategy", ["native", "arrow"])
def test_elementwise(table, strategy):
    s = series()
    plain = {
        "neg": lambda a: -a, "abs": abs, "log": lambda a: math.log(a) if a > 0 else None, "sqr": lambda a: a * a, "inv": lambda a: div(1.0, a + EPS), "sign": lambda a: float(np.sign(a)), "tanh": math.tanh,
        "slog1p": lambda a: math.copysign(math.log1p(abs(a)), a) if a else 0.0,
    }
    for op, f in plain.items():
        check(values(table, X.Expr(op, (X.x,)), strategy), {k: [None if a is None else f(a) for a in v] for k, v in s.items()})
    two = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: div(a, b + EPS)}
    for op, f in two.items():
        check(values(table, X.Expr(op, (X.x, X.y)), strategy), {k: [None if a is None else f(a, a * a - i) for i, a in enumerate(v)] for k, v in s.items()})
        check(values(table, X.Expr(op, (X.x, X.as_expr(2.5))), strategy), {k: [None if a is None else f(a, 2.5) for a in v] for k, v in s.items()})
        check(values(table, X.Expr(op, (X.as_expr(2.5), X.x)), strategy), {k: [None if a is None else f(2.5, a) for a in v] for k, v in s.items()})


def test_division_edges(spark):
    df = spark.createDataFrame([("a", k, k, p, q) for k, (p, q) in enumerate([(1.0, -EPS), (-1.0, -EPS), (0.0, -EPS), (None, 1.0), (1.0, None)])], "symbol string, ts long, seq long, x double, y double")
    for strategy in ("native", "arrow"):
        assert values(df, X.x / X.y, strategy)["a"] == [math.inf, -math.inf, None, None, None]
    cleaned = planner.compute(df, {"v": X.x / X.y}).toPandas()["v"].tolist()
    assert cleaned == [0.0] * 5


def test_one_sort_and_one_exchange(table):
    e = X.ma(X.ts_std(X.ma(X.x, 3), 4), 5) / X.ts_max(X.x, 7)
    plan = planner.compute(table, {"v": e}, strategy="native")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_missing_inputs(table):
    with pytest.raises(ValueError):
        planner.compute(table, {"v": X.ma(X.close, 3)})
    got = planner.compute(table, {"v": X.ma(X.close, 3)}, allow_missing=True, raw=True)
    assert got.where("v is not null").count() == 0


@pytest.mark.parametrize("op", ["ts_std", "ts_vari", "ts_zscore", "ts_skew", "ts_kurt", "ts_ir"])
def test_extreme_values_leave_no_trace(op):
    """An extreme value that has left the window has no share in what follows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=200)
    x[20] = 1e12
    e = X.Expr(op, (X.x,), 30)
    after, alone = arrow.evaluate({"v": e}, {"x": x})["v"][60:], arrow.evaluate({"v": e}, {"x": x[30:]})["v"][30:]
    assert np.allclose(after, alone, rtol=1e-12, atol=0)


def test_extreme_pairs_leave_no_trace():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=200), rng.normal(size=200)
    x[20] = 1e12
    for e in (X.corr(X.x, X.y, 30), X.cov(X.x, X.y, 30)):
        after, alone = (arrow.evaluate({"v": e}, {"x": x[k:], "y": y[k:]})["v"][60 - k :] for k in (0, 30))
        assert np.allclose(after, alone, rtol=1e-12, atol=0)


def test_sample_moments_and_carried_averages():
    x = np.array([1.0, 4.0, NAN, 2.0, 8.0, 5.0, 7.0, NAN, NAN, 3.0, 1.0, 2.0])
    s = pd.Series(x)
    got = arrow.evaluate({"s": X.ts_std(X.x, 3, 1), "v": X.ts_vari(X.x, 3, 1), "c": X.ema(X.x, 3, "carry")}, {"x": x})
    np.testing.assert_allclose(got["s"], s.rolling(3).std(), rtol=1e-12)
    np.testing.assert_allclose(got["v"], s.rolling(3).var(), rtol=1e-12)
    np.testing.assert_allclose(got["c"], s.ewm(span=3, adjust=False, min_periods=3).mean(), rtol=1e-12)
    for bad in (lambda: X.ts_std(X.x, 3, 3), lambda: X.ema(X.x, 3, "skip"), lambda: lookback(X.ema(X.x, 3, "carry"))):
        with pytest.raises(ValueError):
            bad()
