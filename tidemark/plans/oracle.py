"""Expressions as DuckDB SQL, written independently of the executors, to hold their results against."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from tidemark.plans.expr import Expr, abs_, delay, ma

INF, NAN = "'inf'::double", "'nan'::double"


def _finite(x: str) -> str:
    return f"case when abs({x}) < {INF} then {x} end"


def _div(a: str, b: str) -> str:
    return f"nullif(case when {b} <> 0 then ({a}) / ({b}) when {b} = 0 and ({a}) > 0 then {INF} when {b} = 0 and ({a}) < 0 then -({INF}) end, {NAN})"


def cleaned(x: str, digits: int | None = None) -> str:
    out = f"coalesce({_finite(x)}, 0.0)"
    return f"round({out}, {digits}) + 0.0" if digits is not None else out


def _elementwise(op: str, a: str, b: str = "") -> str:
    return {
        "neg": lambda: f"-({a})",
        "abs": lambda: f"abs({a})",
        "log": lambda: f"case when ({a}) > 0 then ln({a}) end",
        "sqr": lambda: f"({a}) * ({a})",
        "inv": lambda: _div("1.0::double", f"(({a}) + 1e-8::double)"),
        "sign": lambda: f"sign({a})::double",
        "tanh": lambda: f"tanh({a})",
        "slog1p": lambda: f"sign({a}) * ln(1.0::double + abs({a}))",
        "add": lambda: f"nullif(({a}) + ({b}), {NAN})",
        "sub": lambda: f"nullif(({a}) - ({b}), {NAN})",
        "mul": lambda: f"nullif(({a}) * ({b}), {NAN})",
        "div": lambda: _div(a, f"(({b}) + 1e-8::double)"),
    }[op]()


class _Windows:
    def __init__(self, keys: str, order: str):
        self.rows = f"partition by {keys} order by {order}"

    def over(self, agg: str, t: int) -> str:
        return f"{agg} over ({self.rows} rows between {t - 1} preceding and current row)"

    def full(self, agg: str, x: str, t: int, least: int | None = None) -> str:
        return f"case when {self.over(f'count({x})', t)} >= {t if least is None else least} then {self.over(agg, t)} end"

    def lag(self, x: str, t: int) -> str:
        return f"lag({x}, {t}) over ({self.rows})" if t else x

    def rolling(self, e: Expr, raw: str, other: str = "") -> str:
        t, x, o, f = e.window, f"({_finite(raw)})", self.over, self.full
        if e.op in ("delay", "ts_diff", "ts_pct"):
            old = self.lag(raw, t)
            return {"delay": old, "ts_diff": f"nullif({raw} - {old}, {NAN})", "ts_pct": f"({_div(raw, f'({old} + 1e-8::double)')}) - 1.0"}[e.op]
        simple = {"ma": "avg", "ts_sum": "sum", "ts_std": "stddev_pop", "ts_vari": "var_pop", "ts_min": "min", "ts_max": "max", "ts_med": "median"}
        if e.op in simple:
            return f(f"{simple[e.op]}({x})", x, t)
        if e.op == "ts_zscore":
            d = f"({f(f'stddev_pop({x})', x, t)})"
            return f"case when {d} >= 1e-8 then ({x} - {o(f'avg({x})', t)}) / ({d} + 1e-8::double) end"
        if e.op == "ts_rank":
            if t < 2:
                return f"{x} * 0.0" if t else "null::double"
            values = o(f"list({x})", t)
            return f"case when {o(f'count({x})', t)} = {t} then (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0::double) / {t} end"
        if e.op == "ts_minmax_diff":
            return f"{o(f'max({x})', t)} - {o(f'min({x})', t)}"
        if e.op in ("ts_max_diff", "ts_min_diff"):
            return f"{x} - {o(f'{e.op[3:6]}({x})', t)}"
        if e.op in ("ts_skew", "ts_kurt"):
            v = f"({f(f'var_pop({x})', x, t)})"
            flat = f"when {v} <= 0 then 0.0" if e.op == "ts_skew" else ""
            return f"case {flat} when {v} > 0 then {o(f'{"skewness" if e.op == "ts_skew" else "kurtosis"}({x})', t)} end" if t >= 3 + (e.op == "ts_kurt") else "null::double"
        if e.op == "ts_ir":
            return _div(f"({f(f'avg({x})', x, t, max(2, t // 2))})", f"({o(f'stddev_samp({x})', t)} + 1e-8::double)")
        if e.op == "ts_wma":
            values = o(f"list({x})", t)
            return f"case when {o(f'count({x})', t)} = {t} then list_sum(list_transform({values}, lambda v, i: v * i)) / {t * (t + 1) / 2} end"
        if e.op == "ts_mad_window":
            values = f"list_filter({o(f'list({x})', t)}, lambda v: v is not null)"
            return f"case when {o(f'count({x})', t)} >= {max(2, t // 2)} then list_aggregate(list_transform({values}, lambda v: abs(v - {o(f'median({x})', t)})), 'median') end"
        if e.op in ("corr", "cov", "autocorr"):
            if t < 2 or e.op == "autocorr" and e.lag < 1:
                return "null::double"
            y = f"({_finite(other)})" if e.op != "autocorr" else f"({self.lag(x, e.lag)})"
            raise _Paired(x, y)
        raise NotImplementedError(e.op)

    def paired(self, e: Expr, a: str, b: str) -> str:
        """a and b are columns, NULL together."""
        if e.op == "cov":
            return self.full(f"covar_samp({a}, {b})", a, e.window)
        s = f"({self.over(f'stddev_pop({a})', e.window)} * {self.over(f'stddev_pop({b})', e.window)})"
        return f"case when {self.over(f'count({a})', e.window)} = {e.window} and {s} > 0 then {self.over(f'covar_pop({a}, {b})', e.window)} / {s} end"


class _Paired(Exception):
    pass


def _spelled(e: Expr) -> Expr:
    args = tuple(_spelled(a) for a in e.args)
    if e.op == "autocorr_double":
        a, old, t = args[0], delay(args[0], e.lag), e.window
        top = ma((a - ma(a, t)) * (old - ma(old, t)), t)
        return _Inner("_ratio", (top, _Inner("_samp", (a,), t), _Inner("_samp", (old,), t)))
    if e.op == "ts_mad":
        middle = _Inner("_med", args, e.window)
        return _Inner("_med", (abs_(args[0] - middle),), e.window)
    return Expr(e.op, args, e.window, e.lag, e.value)


class _Inner(Expr):
    def __post_init__(self) -> None:
        pass

    __hash__ = Expr.__hash__


def select(table: str, exprs: Mapping[str, Expr], keys: str = "symbol", order: str = "ts, seq", digits: int | None = 6, ctes: str = "") -> str:
    """SQL for keys, order and cleaned, rounded values of expressions over a table or named CTE.

    Each rolling or shared node is a column of a CTE above that of its operands.
    """
    w, roots = _Windows(keys, order), {n: _spelled(e) for n, e in exprs.items()}
    nodes: dict[Expr, None] = {}
    for e in roots.values():
        for n in e.nodes():
            nodes.setdefault(n)
    uses = Counter(a for n in nodes for a in set(n.args))
    levels: list[list[str]] = []
    text: dict[Expr, str] = {}
    at: dict[Expr, int] = {}

    def put(level: int, column: str) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(column)

    for k, n in enumerate(nodes):
        if n.op == "input":
            text[n], at[n] = f"{n.value}::double", 0
            continue
        if n.op == "const":
            text[n], at[n] = f"{float(n.value)!r}::double", 0
            continue
        args, level, name = [text[a] for a in n.args], max(at[a] for a in n.args), f"_e{k}"
        window = n.window > 0 or n.op in ("ts_rank", "delay", "ts_diff", "ts_pct")
        if window:  # operands as columns, then the window above them
            for j, a in enumerate(args):
                if not a.startswith("_e"):
                    put(level, f"{a} as {name}_{j}")
                    args[j] = f"{name}_{j}"
            level += any(a.startswith(f"{name}_") for a in args)
            if n.op == "ema":
                x, t = args[0], n.window
                put(level, f"sum(case when {x} is null then 1 else 0 end) over ({w.rows} rows unbounded preceding) as {name}_run")
                over = f"over (partition by {keys}, {name}_run order by {order} rows unbounded preceding)"
                a = repr(2.0 / (t + 1))
                put(level + 1, f"case when {x} is not null and count({x}) {over} >= {t} then list_reduce(list({x}) filter ({x} is not null) {over}, lambda p, q: p + {a}::double * (q - p)) end as {name}")
                level += 1
            elif n.op == "_samp":
                put(level, f"{w.full(f'stddev_samp({args[0]})', args[0], n.window)} as {name}")
            elif n.op == "_med":
                put(level, f"{w.full(f'median({args[0]})', args[0], n.window, max(2, n.window // 2))} as {name}")
            else:
                try:
                    put(level, f"{w.rolling(n, *args)} as {name}")
                except _Paired as two:
                    x, y = two.args
                    put(level, f"{x} as {name}_x")
                    put(level, f"{y} as {name}_y")
                    put(level + 1, f"case when {name}_y is not null then {name}_x end as {name}_p")
                    put(level + 1, f"case when {name}_x is not null then {name}_y end as {name}_q")
                    put(level + 2, f"{w.paired(n, f'{name}_p', f'{name}_q')} as {name}")
                    level += 2
            text[n], at[n] = name, level + 1
        else:
            made = f"case when {args[1]} > 0 and {args[2]} > 0 then {args[0]} / ({args[1]} * {args[2]}) end" if n.op == "_ratio" else _elementwise(n.op, *args)
            if uses[n] > 1 or len(made) > 400:
                put(level, f"{made} as {name}")
                text[n], at[n] = name, level + 1
            else:
                text[n], at[n] = f"({made})", level
    out, source = [ctes] if ctes else [], table
    for k, columns in enumerate(levels):
        out.append(f"_l{k} as (select *, {', '.join(columns)} from {source})")
        source = f"_l{k}"
    values = ", ".join(f"{cleaned(text[e], digits)} as {n}" for n, e in roots.items())
    head = f"with {', '.join(out)} " if out else ""
    return f"{head}select {keys}, {order}, {values} from {source}"
