"""Expressions as window functions of a DataFrame: rows frames of [i - t + 1, i] per symbol, JVM-side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.expr import Expr, abs_, delay, ma

EPS = 1e-8
INF = float("inf")


def null(c: str = "double") -> Column:
    return F.lit(None).cast(c)


def finite(c: Column) -> Column:
    """NULL for infinities and NaN (which sorts above infinity)."""
    return F.when(F.abs(c) < INF, c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with a signed infinity for a division by zero, and NULL for 0 / 0 and infinity / infinity."""
    q = F.when(b != 0, a / b).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF))
    return F.nullif(q, F.lit(float("nan")))


def clean(c: Column) -> Column:
    """The final value: NULL, NaN and infinities become 0; no negative zero."""
    return F.coalesce(finite(c), F.lit(0.0)) + 0.0


def elementwise(op: str, args: list[Column]) -> Column:
    a = args[0]
    if op == "neg":
        return -a
    if op == "abs":
        return F.abs(a)
    if op == "log":
        return F.ln(a)  # NULL at and below 0
    if op == "sqr":
        return a * a
    if op == "inv":
        return safe_div(F.lit(1.0), a + EPS)
    if op == "sign":
        return F.signum(a)
    if op == "tanh":
        return F.tanh(a)
    if op == "slog1p":
        return F.signum(a) * F.log1p(F.abs(a))
    b = args[1]
    if op == "div":
        return safe_div(a, b + EPS)
    made = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[op]()
    return F.nullif(made, F.lit(float("nan")))


class Frames:
    """Windows of one partitioning and order."""

    def __init__(self, keys: list[str], order: list[str]):
        self.rows = Window.partitionBy(*keys).orderBy(*order)

    def over(self, c: Column, t: int) -> Column:
        return c.over(self.rows.rowsBetween(-(t - 1), 0))

    def full(self, agg: Column, x: Column, t: int, least: int | None = None) -> Column:
        """agg where the frame has ``least`` (all t) values of x."""
        return F.when(self.over(F.count(x), t) >= (t if least is None else least), self.over(agg, t))

    def rolling(self, e: Expr, args: list[Column]) -> Column:
        t, op = e.window, e.op
        raw, x = args[0], finite(args[0])
        if op in ("delay", "ts_diff", "ts_pct"):
            old = F.lag(raw, t).over(self.rows) if t else raw
            if op == "delay":
                return old
            return F.nullif(raw - old, F.lit(float("nan"))) if op == "ts_diff" else safe_div(raw, old + EPS) - 1.0
        if op == "ma":
            return self.full(F.avg(x), x, t)
        if op == "ts_sum":
            return self.full(F.sum(x), x, t)
        if op == "ts_std":
            return self.full(F.stddev_pop(x), x, t)
        if op == "ts_vari":
            return self.full(F.var_pop(x), x, t)
        if op == "ts_min":
            return self.full(F.min(x), x, t)
        if op == "ts_max":
            return self.full(F.max(x), x, t)
        if op == "ts_med":
            return self.full(F.percentile(x, 0.5), x, t)
        if op == "ts_zscore":
            deviation = self.full(F.stddev_pop(x), x, t)
            return F.when(deviation >= EPS, (x - self.over(F.avg(x), t)) / (deviation + EPS))
        if op == "ts_rank":
            if t == 0:
                return null()
            if t == 1:
                return x * 0.0
            values = self.full(F.collect_list(x), x, t)
            return (F.size(F.filter(values, lambda v: v < x)) + (F.size(F.filter(values, lambda v: v == x)) + 1) / 2.0) / t
        if op == "ts_minmax_diff":
            return self.over(F.max(x), t) - self.over(F.min(x), t)
        if op == "ts_max_diff":
            return x - self.over(F.max(x), t)
        if op == "ts_min_diff":
            return x - self.over(F.min(x), t)
        if op == "ts_skew":
            if t < 3:
                return null()
            spread = self.full(F.var_pop(x), x, t)
            return F.when(spread <= 0, F.lit(0.0)).when(spread > 0, self.over(F.skewness(x), t) * ((t * (t - 1)) ** 0.5 / (t - 2)))
        if op == "ts_kurt":
            if t < 4:
                return null()
            spread = self.full(F.var_pop(x), x, t)
            return F.when(spread > 0, (self.over(F.kurtosis(x), t) * (t + 1) + 6.0) * ((t - 1) / ((t - 2) * (t - 3))))
        if op == "ts_ir":
            return safe_div(self.full(F.avg(x), x, t, max(2, t // 2)), self.over(F.stddev_samp(x), t) + EPS)
        if op == "ts_wma":
            n = F.row_number().over(self.rows)
            return self.full(F.sum(n * x), x, t) / (t * (t + 1) / 2) - (n - t) * self.over(F.sum(x), t) / (t * (t + 1) / 2)
        if op == "ts_mad_window":
            values = self.full(F.collect_list(x), x, t, max(2, t // 2))
            middle = self.over(F.percentile(x, 0.5), t)
            away = F.array_sort(F.transform(values, lambda v: F.abs(v - middle)))
            n = F.size(away)
            return (F.get(away, F.floor((n - 1) / 2).cast("int")) + F.get(away, F.floor(n / 2).cast("int"))) / 2.0
        if op in ("corr", "cov", "autocorr"):
            if t < 2 or op == "autocorr" and e.lag < 1:
                return null()
            b = finite(args[1]) if op != "autocorr" else F.lag(x, e.lag).over(self.rows)
            x, b = F.when(b.isNotNull(), x), F.when(x.isNotNull(), b)
            both = F.when(x.isNotNull() & b.isNotNull(), x)
            if op == "cov":
                return self.full(F.covar_samp(x, b), both, t)
            spread = self.over(F.stddev_pop(x), t) * self.over(F.stddev_pop(b), t)
            return F.when((self.over(F.count(both), t) == t) & (spread > 0), self.over(F.covar_pop(x, b), t) / spread)
        raise NotImplementedError(op)


class _Part(Expr):
    """A node made by expansion, outside the public operators."""

    def __post_init__(self) -> None:
        pass

    __hash__ = Expr.__hash__

    @property
    def rolling(self) -> bool:
        return self.op != "ratio"


def expand(e: Expr) -> Expr:
    """Spell out operators that need one frame's values within another frame."""
    args = tuple(expand(a) for a in e.args)
    if e.op == "autocorr_double" and e.window >= 2 and e.lag >= 1:
        a, t = args[0], e.window
        old = delay(a, e.lag)
        return _Part("ratio", (ma((a - ma(a, t)) * (old - ma(old, t)), t), _Part("samp", (a,), t), _Part("samp", (old,), t)))
    if e.op == "ts_mad":
        least = max(2, e.window // 2)
        middle = _Part("ts_med_least", args, e.window, least)
        return _Part("ts_med_least", (abs_(args[0] - middle),), e.window, least)
    return Expr(e.op, args, e.window, e.lag, e.value)


def lower(df: DataFrame, exprs: Mapping[str, Expr], keys: list[str], order: list[str]) -> DataFrame:
    """df with one column for each expression. Rolling nodes and shared ones are columns of their own, a
    projection for each level; all levels share one partitioning and sort."""
    frames, roots = Frames(keys, order), {name: expand(e) for name, e in exprs.items()}
    uses: Counter[Expr] = Counter()
    nodes: dict[Expr, None] = {}
    for e in roots.values():
        for n in e.nodes():
            nodes.setdefault(n)
    for n in nodes:
        uses.update(set(n.args))
    needed = {a for n in nodes if n.rolling for a in n.args}
    level: dict[Expr, int] = {}
    named: dict[Expr, str] = {}
    built: dict[Expr, Column] = {}
    stages: dict[int, dict[str, Column]] = {}
    for k, n in enumerate(nodes):
        if n.op == "input":
            built[n], level[n] = F.col(str(n.value)).cast("double"), 0
            continue
        if n.op == "const":
            built[n], level[n] = F.lit(float(n.value)), 0
            continue
        args, at = [built[a] for a in n.args], max(level[a] for a in n.args)
        if n.op == "samp":
            c = frames.full(F.stddev_samp(finite(args[0])), finite(args[0]), n.window)
        elif n.op == "ts_med_least":
            c = frames.full(F.percentile(finite(args[0]), 0.5), finite(args[0]), n.window, n.lag)
        elif n.op == "ratio":
            c = F.when((args[1] > 0) & (args[2] > 0), args[0] / (args[1] * args[2]))
        elif n.op == "autocorr_double":
            c = null()
        elif n.rolling:
            c = frames.rolling(n, args)
        else:
            c = elementwise(n.op, args)
        if n.rolling or n in needed or uses[n] > 1:
            named[n] = f"_e{k}"
            stages.setdefault(at, {})[named[n]] = c
            built[n], level[n] = F.col(named[n]), at + 1
        else:
            built[n], level[n] = c, at
    for at in sorted(stages):
        df = df.withColumns(stages[at])
    return df.withColumns({name: built[e] for name, e in roots.items()}).drop(*named.values())
