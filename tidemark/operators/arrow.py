"""Expressions by numpy kernels, one pass over each symbol's rows: for recursions and for many factors at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators.native import EPS
from tidemark.plans.expr import Expr

NAN = np.nan


def ema(x: np.ndarray, t: int) -> np.ndarray:
    """a = 2 / (t + 1), seeded by the first value; a missing value starts anew; NaN until t values in a row."""
    out, gone = np.full(len(x), NAN), np.isnan(x)
    bounds = np.concatenate([[-1], np.flatnonzero(gone), [len(x)]])
    for a, b in zip(bounds[:-1] + 1, bounds[1:], strict=True):
        if b - a >= t:
            out[a + t - 1 : b] = pd.Series(x[a:b]).ewm(span=t, adjust=False).mean().to_numpy()[t - 1 :]
    return out


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        q = a / b
        return np.where(b != 0, q, np.where(a > 0, np.inf, np.where(a < 0, -np.inf, NAN)))


def _shift(x: np.ndarray, t: int) -> np.ndarray:
    if not t:
        return x
    out = np.full(len(x), NAN)
    out[t:] = x[: max(0, len(x) - t)]
    return out


def _windows(x: np.ndarray, t: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows of t rows that end at each row, missing values before the first; as many at a time as a cache holds."""
    step = max(1, (1 << 16) // t)
    whole = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(t - 1, NAN), x]), t) if len(x) else np.zeros((0, t))
    for a in range(0, len(x), step):
        yield slice(a, a + step), whole[a : a + step]


def _centred(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of rows, and the values less their row's mean, 0 for missing ones; exactly 0 in a row of equal values."""
    whole = bool((n == rows.shape[1]).all())
    pivot = rows[:, -1] if whole else np.nan_to_num(np.fmax.reduce(rows, axis=1))
    near = rows - pivot[:, None] if whole else np.nan_to_num(rows - pivot[:, None])
    mean = near.sum(1) / n
    near -= mean[:, None]
    return pivot + mean, near if whole else np.where(np.isnan(rows), 0.0, near)


def _moments(x: np.ndarray, t: int, least: int, *powers: int) -> tuple[np.ndarray, ...]:
    """Count, mean and sums of powers of deviations in each window, NaN for fewer than ``least`` values.

    Each window is summed from scratch: sums that roll keep the rounding of an extreme value that has left.
    """
    out = tuple(np.full(len(x), NAN) for _ in range(2 + len(powers)))
    for at, rows in _windows(x, t):
        n = (~np.isnan(rows)).sum(1).astype(np.float64)
        mean, d = _centred(rows, n)
        for o, v in zip(out, (n, mean, *((d * d if p == 2 else d**p).sum(1) for p in powers)), strict=True):
            o[at] = np.where(n >= least, v, NAN)
    return out


def _pairs(x: np.ndarray, y: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of squares of deviations of x and y, and of their products, in each window of t pairs without a gap."""
    both = np.isfinite(x) & np.isfinite(y)
    out = tuple(np.full(len(x), NAN) for _ in range(3))
    for (at, a), (_, b) in zip(_windows(np.where(both, x, NAN), t), _windows(np.where(both, y, NAN), t), strict=True):
        n = (~np.isnan(a)).sum(1).astype(np.float64)
        d, e = _centred(a, n)[1], _centred(b, n)[1]
        for o, v in zip(out, (d * d, e * e, d * e), strict=True):
            o[at] = np.where(n == t, v.sum(1), NAN)
    return out


def _corr(x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
    a, b, c = _pairs(x, y, t)
    spread = np.sqrt(a) * np.sqrt(b)
    with np.errstate(all="ignore"):
        return np.where(spread > 0, c / spread, NAN)


def kernel(e: Expr, args: list[np.ndarray]) -> np.ndarray:
    op, t, x = e.op, e.window, args[0]
    with np.errstate(all="ignore"):
        if op == "neg":
            return -x
        if op == "abs":
            return np.abs(x)
        if op == "log":
            return np.where(x > 0, np.log(np.where(x > 0, x, 1.0)), NAN)
        if op == "sqr":
            return x * x
        if op == "inv":
            return _div(np.ones_like(x), x + EPS)
        if op == "sign":
            return np.sign(x)
        if op == "tanh":
            return np.tanh(x)
        if op == "slog1p":
            return np.sign(x) * np.log1p(np.abs(x))
        if op == "add":
            return x + args[1]
        if op == "sub":
            return x - args[1]
        if op == "mul":
            return x * args[1]
        if op == "div":
            return _div(x, args[1] + EPS)
        if op in ("delay", "ts_diff", "ts_pct"):
            old = _shift(x, t)
            return old if op == "delay" else x - old if op == "ts_diff" else _div(x, old + EPS) - 1
        f = np.where(np.isfinite(x), x, NAN)
        s = pd.Series(f)
        r = lambda least=t: s.rolling(t, min_periods=least)
        if op == "ema":
            return ema(f, t)
        if op == "ema_carry":
            return s.ewm(span=t, adjust=False, min_periods=t).mean().to_numpy()
        if op == "ts_rank":
            return f * NAN if t == 0 else f * 0.0 if t == 1 else r().rank(pct=True).to_numpy()
        if op in ("ma", "ts_sum", "ts_min", "ts_max", "ts_med"):
            return getattr(r(), {"ma": "mean", "ts_sum": "sum", "ts_min": "min", "ts_max": "max", "ts_med": "median"}[op])().to_numpy()
        if op == "ts_std":
            return np.sqrt(_moments(f, t, t, 2)[2] / t)
        if op == "ts_vari":
            return _moments(f, t, t, 2)[2] / t
        if op == "ts_zscore":
            _, mean, square = _moments(f, t, t, 2)
            deviation = np.sqrt(square / t)
            return np.where(deviation >= EPS, (f - mean) / (deviation + EPS), NAN)
        if op == "ts_minmax_diff":
            return (r(1).max() - r(1).min()).to_numpy()
        if op == "ts_max_diff":
            return f - r(1).max().to_numpy()
        if op == "ts_min_diff":
            return f - r(1).min().to_numpy()
        if op in ("ts_skew", "ts_kurt"):
            if t < 3 + (op == "ts_kurt"):
                return f * NAN
            _, _, square, high = _moments(f, t, t, 2, 3 if op == "ts_skew" else 4)
            if op == "ts_skew":
                got = t * np.sqrt(t - 1.0) / (t - 2) * high / square**1.5
            else:
                got = (t - 1.0) / ((t - 2) * (t - 3)) * ((t + 1) * t * high / square**2 - 3 * (t - 1))
            return np.where(square > 0, got, np.where(square == 0, 0.0 if op == "ts_skew" else NAN, NAN))
        if op == "ts_ir":
            least = max(2, t // 2)
            n, mean, square = _moments(f, t, least, 2)
            return _div(mean, np.sqrt(square / (n - 1)) + EPS)
        if op == "ts_wma":
            out = np.full(len(f), NAN)
            if len(f) >= t:
                out[t - 1 :] = np.convolve(np.nan_to_num(f), np.arange(t, 0, -1) / (t * (t + 1) / 2), "valid")
            return np.where(s.rolling(t, min_periods=1).count().to_numpy() == t, out, NAN)
        if op == "ts_mad":
            least = max(2, t // 2)
            return (s - r(least).median()).abs().rolling(t, min_periods=least).median().to_numpy()
        if op == "ts_mad_window":
            least = max(2, t // 2)
            return _window_mad(f, t, least)
        if op == "corr":
            return _corr(x, args[1], t) if t >= 2 else f * NAN
        if op == "cov":
            return _pairs(x, args[1], t)[2] / (t - 1) if t >= 2 else f * NAN
        if op == "autocorr":
            return _corr(f, _shift(f, e.lag), t) if t >= 2 and e.lag >= 1 else f * NAN
        if op == "autocorr_double":
            if t < 2 or e.lag < 1:
                return f * NAN
            old = pd.Series(_shift(f, e.lag))
            q = lambda v: v.rolling(t, min_periods=t)
            top = q((s - q(s).mean()) * (old - q(old).mean())).mean().to_numpy()
            a, b = (np.sqrt(_moments(v.to_numpy(), t, t, 2)[2] / (t - 1)) for v in (s, old))
            return np.where((a > 0) & (b > 0), top / (a * b), NAN)
    raise NotImplementedError(op)


def _medians(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of each row's values without the missing ones, and how many there are."""
    ordered, n = np.sort(rows, axis=1), (~np.isnan(rows)).sum(1)
    at = np.arange(len(rows))
    return (ordered[at, np.maximum(n - 1, 0) // 2] + ordered[at, np.minimum(n // 2, rows.shape[1] - 1)]) / 2, n


def _window_mad(x: np.ndarray, t: int, least: int) -> np.ndarray:
    """Median distance from the median in each window of t rows with ``least`` values."""
    out = np.full(len(x), NAN)
    for at, rows in _windows(x, t) if t >= 1 else ():
        middle, n = _medians(rows)
        far, _ = _medians(np.abs(rows - middle[:, None]))
        out[at] = np.where(n >= least, far, NAN)
    return out


def evaluate(exprs: Mapping[str, Expr], columns: Mapping[str, np.ndarray], single: bool = False) -> dict[str, np.ndarray]:
    """Values of expressions over one symbol's rows in order; each distinct node is computed once.

    single rounds inputs and every node's result to single precision; sums within a node stay double.
    """
    n = len(next(iter(columns.values())))
    cast = (lambda v: v.astype(np.float32).astype(np.float64)) if single else (lambda v: v)
    done: dict[Expr, np.ndarray] = {}
    for e in exprs.values():
        for node in e.nodes():
            if node in done:
                continue
            if node.op == "input":
                done[node] = cast(np.asarray(columns[str(node.value)], np.float64))
            elif node.op == "const":
                done[node] = cast(np.full(n, float(node.value)))
            else:
                with np.errstate(over="ignore"):
                    done[node] = cast(kernel(node, [done[a] for a in node.args]))
    return {name: done[e] for name, e in exprs.items()}


def inputs_of(exprs: Mapping[str, Expr]) -> list[str]:
    return sorted({i for e in exprs.values() for i in e.inputs()})


def lower(df: DataFrame, exprs: Mapping[str, Expr], keys: list[str], order: list[str], extra: list[str] | None = None, single: bool = False) -> DataFrame:
    """Keys, order, ``extra`` columns and one column for each expression, by one grouped pass for each key."""
    names, carried = inputs_of(exprs), [*keys, *order, *(extra or [])]
    schema = T.StructType([df.schema[c] for c in dict.fromkeys(carried)] + [T.StructField(n, T.DoubleType()) for n in exprs])
    exprs = dict(exprs)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        values = evaluate(exprs, {i: t.column(i).to_numpy().astype(np.float64) for i in names} or {"_": np.zeros(t.num_rows)}, single)
        out = {c: t.column(c) for c in dict.fromkeys(carried)}
        return pa.table(out | {n: pa.array(v, pa.float64(), from_pandas=True) for n, v in values.items()})

    wanted = [*dict.fromkeys([*carried, *names])]
    return df.select(*wanted).groupBy(*keys).applyInArrow(run, schema)
