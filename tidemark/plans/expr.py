"""Expressions over bars: an immutable tree of inputs, constants, elementwise and rolling operators.

Missing values are NULL. Build expressions with the functions below and Python's arithmetic operators; equal
sub-expressions compare equal, so a planner computes each of them once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

INPUTS = ("close", "volume", "open", "high", "low", "ret", "x", "y")
UNARY = frozenset({"neg", "abs", "log", "sqr", "inv", "sign", "tanh", "slog1p"})
BINARY = frozenset({"add", "sub", "mul", "div"})
#: Operators of one series and a window.
ROLLING = frozenset(
    "ma ts_sum ts_std ts_vari ema ema_carry ts_min ts_max ts_rank ts_zscore delay ts_diff ts_pct ts_minmax_diff ts_skew ts_kurt ts_med ts_mad ts_mad_window ts_wma ts_max_diff ts_min_diff ts_ir".split()
)
#: Those that build on their own last value; they have no window frame.
RECURSIVE = frozenset({"ema", "ema_carry"})
PAIRED = frozenset({"corr", "cov"})
LAGGED = frozenset({"autocorr", "autocorr_double"})


@dataclass(frozen=True)
class Expr:
    op: str
    args: tuple[Expr, ...] = ()
    window: int = 0
    lag: int = 0
    value: float | str = 0.0

    def __post_init__(self) -> None:
        n = len(self.args)
        if self.op == "input":
            if self.value not in INPUTS:
                raise ValueError(f"unknown input {self.value!r}; inputs are {', '.join(INPUTS)}")
        elif self.op == "const":
            if not isinstance(self.value, int | float):
                raise TypeError("a constant must be a number")
        elif self.op in UNARY | BINARY:
            if n != 1 + (self.op in BINARY):
                raise ValueError(f"{self.op} takes {1 + (self.op in BINARY)} operands, not {n}")
        elif self.op in ROLLING | PAIRED | LAGGED:
            if n != 1 + (self.op in PAIRED):
                raise ValueError(f"{self.op} takes {1 + (self.op in PAIRED)} series, not {n}")
            if not isinstance(self.window, int) or self.window < (0 if self.op in ("ts_rank", "delay", "ts_diff", "ts_pct") else 1):
                raise ValueError(f"{self.op}: window {self.window!r}")
        else:
            raise ValueError(f"unknown operator {self.op!r}")

    @cached_property
    def _hash(self) -> int:
        return hash((self.op, self.args, self.window, self.lag, self.value))

    def __hash__(self) -> int:
        return self._hash

    @property
    def rolling(self) -> bool:
        return self.op in ROLLING | PAIRED | LAGGED

    def nodes(self) -> Iterator[Expr]:
        """Distinct nodes, operands first."""
        seen: set[Expr] = set()

        def walk(e: Expr) -> Iterator[Expr]:
            if e not in seen:
                for a in e.args:
                    yield from walk(a)
                if e not in seen:
                    seen.add(e)
                    yield e

        yield from walk(self)

    def warmup(self) -> int:
        """Bars counted along the longest path: windows, and lags of autocorrelations, of rolling nodes."""
        below = max((a.warmup() for a in self.args), default=0)
        return below + (self.window if self.rolling else 0) + (self.lag if self.op in LAGGED else 0)

    def first(self) -> int:
        """The first bar, from 1, at which the value can be other than NULL."""
        below = max((a.first() for a in self.args), default=1)
        if not self.rolling:
            return below
        if self.op in ("delay", "ts_diff", "ts_pct"):
            return below + self.window
        if self.op in ("ts_minmax_diff", "ts_max_diff", "ts_min_diff"):
            return below
        if self.op in ("ts_mad", "ts_mad_window", "ts_ir"):
            return below + max(2, self.window // 2) - 1
        if self.op == "autocorr_double":
            return below + 2 * (self.window - 1) + self.lag
        return below + max(1, self.window) - 1 + self.lag

    def inputs(self) -> list[str]:
        return sorted({str(e.value) for e in self.nodes() if e.op == "input"})

    def __str__(self) -> str:
        if self.op == "input":
            return str(self.value)
        if self.op == "const":
            return repr(self.value)
        extra = [str(v) for v, on in ((self.window, self.rolling), (self.lag, self.op in LAGGED)) if on]
        return f"{self.op}({', '.join([*map(str, self.args), *extra])})"

    def __neg__(self) -> Expr:
        return Expr("neg", (self,))

    def __add__(self, other: Expr | float) -> Expr:
        return Expr("add", (self, as_expr(other)))

    def __radd__(self, other: float) -> Expr:
        return Expr("add", (as_expr(other), self))

    def __sub__(self, other: Expr | float) -> Expr:
        return Expr("sub", (self, as_expr(other)))

    def __rsub__(self, other: float) -> Expr:
        return Expr("sub", (as_expr(other), self))

    def __mul__(self, other: Expr | float) -> Expr:
        return Expr("mul", (self, as_expr(other)))

    def __rmul__(self, other: float) -> Expr:
        return Expr("mul", (as_expr(other), self))

    def __truediv__(self, other: Expr | float) -> Expr:
        return Expr("div", (self, as_expr(other)))

    def __rtruediv__(self, other: float) -> Expr:
        return Expr("div", (as_expr(other), self))


def as_expr(x: Expr | float) -> Expr:
    return x if isinstance(x, Expr) else Expr("const", value=float(x))


def source(name: str) -> Expr:
    return Expr("input", value=name)


close, volume, open_, high, low, ret, x, y = (source(n) for n in ("close", "volume", "open", "high", "low", "ret", "x", "y"))


def _unary(op: str):
    def build(a: Expr) -> Expr:
        return Expr(op, (as_expr(a),))

    build.__name__ = op
    return build


def _rolling(op: str):
    def build(a: Expr, t: int) -> Expr:
        return Expr(op, (as_expr(a),), t)

    build.__name__ = op
    return build


neg, abs_, log, sqr, inv, sign, tanh, slog1p = map(_unary, ("neg", "abs", "log", "sqr", "inv", "sign", "tanh", "slog1p"))
ma, ts_sum, ts_min, ts_max = map(_rolling, ("ma", "ts_sum", "ts_min", "ts_max"))
ts_rank, ts_zscore, delay, ts_diff, ts_pct = map(_rolling, ("ts_rank", "ts_zscore", "delay", "ts_diff", "ts_pct"))
ts_minmax_diff, ts_skew, ts_kurt, ts_med, ts_mad = map(_rolling, ("ts_minmax_diff", "ts_skew", "ts_kurt", "ts_med", "ts_mad"))
ts_mad_window, ts_wma, ts_max_diff, ts_min_diff, ts_ir = map(_rolling, ("ts_mad_window", "ts_wma", "ts_max_diff", "ts_min_diff", "ts_ir"))
pct_change = ts_pct


def _scale(t: int, ddof: int) -> float:
    if not 0 <= ddof < t:
        raise ValueError(f"ddof {ddof!r} with window {t!r}")
    return t / (t - ddof)


def ts_vari(a: Expr, t: int, ddof: int = 0) -> Expr:
    """Variance over t bars, divided by t - ddof."""
    e = Expr("ts_vari", (as_expr(a),), t)
    return e * _scale(t, ddof) if ddof else e


def ts_std(a: Expr, t: int, ddof: int = 0) -> Expr:
    """Root of the variance over t bars, divided by t - ddof."""
    e = Expr("ts_std", (as_expr(a),), t)
    return e * math.sqrt(_scale(t, ddof)) if ddof else e


def ema(a: Expr, t: int, on_null: str = "restart") -> Expr:
    """a = 2 / (t + 1). After a missing value it starts anew, or ("carry") goes on with the weights decayed."""
    if on_null not in ("restart", "carry"):
        raise ValueError(f"on_null must be restart or carry, not {on_null!r}")
    return Expr("ema" if on_null == "restart" else "ema_carry", (as_expr(a),), t)


def treap_ts_rank(a: Expr, t: int) -> Expr:
    """The rank by another algorithm elsewhere; here the same expression, the executor picks the algorithm."""
    return ts_rank(a, t)


def corr(a: Expr, b: Expr, t: int) -> Expr:
    return Expr("corr", (as_expr(a), as_expr(b)), t)


def cov(a: Expr, b: Expr, t: int) -> Expr:
    return Expr("cov", (as_expr(a), as_expr(b)), t)


def autocorr(a: Expr, t: int, n: int) -> Expr:
    """Correlation of a with itself n bars ago."""
    return Expr("autocorr", (as_expr(a),), t, n)


def autocorr_double(a: Expr, t: int, n: int) -> Expr:
    """Rolling mean of the products of deviations from rolling means, over sample deviations."""
    return Expr("autocorr_double", (as_expr(a),), t, n)
