"""Choice of executor, validation and output of factors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import arrow, native
from tidemark.plans.expr import RECURSIVE, Expr
from tidemark.plans.slicing import sliced

#: Frames of these that have at most so many rows cost no more than the pass through Arrow; Spark computes each
#: row's frame from scratch, so longer ones, and those of all other operators, lose to one pass of kernels.
SHORT = 30
_LIGHT = frozenset({"ma", "ts_sum", "ts_std", "ts_vari", "ts_min", "ts_max", "ts_zscore", "ts_wma", "ts_minmax_diff", "ts_max_diff", "ts_min_diff", "ts_ir"})
_SHIFTS = frozenset({"delay", "ts_diff", "ts_pct"})
#: Rows of a key's slice, where its series is longer and the plan's own estimate is beyond so many bytes.
SLICE_ROWS, BIG = 2_000_000, 1 << 30


def choose(exprs: Mapping[str, Expr]) -> str:
    """"native" for elementwise expressions, shifts and up to four short light frames, else "arrow"."""
    nodes = {n for e in exprs.values() for n in e.nodes() if n.rolling and n.op not in _SHIFTS}
    return "native" if len(nodes) <= 4 and all(n.op in _LIGHT and n.window <= SHORT for n in nodes) else "arrow"


def slices(df: DataFrame, keys: list[str]) -> int:
    """Rows to a slice for df, 0 if its series needn't be cut.

    The estimate comes with the plan; only beyond ``BIG`` bytes are the keys' rows counted.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BIG:
        return 0
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return SLICE_ROWS if (longest or 0) > SLICE_ROWS else 0


def compute(
    df: DataFrame, exprs: Mapping[str, Expr], keys: list[str] | None = None, order: list[str] | None = None, raw: bool = False, strategy: str | None = None, ready: bool = False, allow_missing: bool = False,
    slice_rows: int | None = None, precision: str = "double",
) -> DataFrame:
    """Keys, order and one column for each expression.

    The order must be total within a key, else rows with equal order may swap. Values are cleaned (missing and
    infinite ones are 0) unless raw. ready adds, for each expression, whether its value was there.

    slice_rows deals a key's rows to tasks of so many rows each, with the rows that values look back on in front,
    so that one very long series doesn't sit in one task. Averages that recur reach back further than a double
    can tell (see ``slicing``). Without it, ``slices`` decides; 0 never cuts.

    precision "single" rounds every node's result to single precision, as engines do that hold floats.
    """
    if precision not in ("double", "single"):
        raise ValueError(f"unknown precision {precision!r}")
    if precision == "single" and strategy == "native":
        raise ValueError("single precision needs the arrow strategy")
    keys, order = keys or ["symbol"], order or ["ts", "seq"]
    if missing := [i for i in arrow.inputs_of(exprs) if i not in df.columns]:
        if not allow_missing:
            raise ValueError(f"inputs are missing: {', '.join(missing)}")
        df = df.withColumns({i: F.lit(None).cast("double") for i in missing})
    strategy, groups = strategy or ("arrow" if precision == "single" else choose(exprs)), keys
    if slice_rows is None and not any(n.op == "ema_carry" for e in exprs.values() for n in e.nodes()):
        slice_rows = slices(df.select(*dict.fromkeys([*keys, *order, *arrow.inputs_of(exprs)])), keys)
    if slice_rows:
        df = sliced(df.select(*dict.fromkeys([*keys, *order, *arrow.inputs_of(exprs)])), exprs, keys, order, slice_rows)
        groups = [*keys, "_slice"]
    extra = ["_lead"] if slice_rows else []
    if strategy == "native":
        if any(n.op in RECURSIVE for e in exprs.values() for n in e.nodes()):
            raise ValueError("ema is recursive and has no window frame; use the arrow strategy")
        out = native.lower(df.select(*dict.fromkeys([*groups, *order, *arrow.inputs_of(exprs), *extra])), exprs, groups, order).select(*groups, *order, *extra, *exprs)
    elif strategy == "arrow":
        out = arrow.lower(df, exprs, groups, order, extra, precision == "single")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if slice_rows:
        out = out.where(~F.col("_lead")).drop("_lead", "_slice")
    flags = {f"{n}_ready": F.col(n).isNotNull() for n in exprs} if ready else {}
    out = out.withColumns(flags) if flags else out
    return out if raw else out.withColumns({n: native.clean(F.col(n)) for n in exprs})


def long_form(wide: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, factor_id, value) rows of a wide result."""
    keys = keys or ["symbol", "ts", "seq"]
    return wide.unpivot(keys, names, "factor_id", "value")


def latest(wide: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The last row of each key, by an aggregate with partial maxima rather than a window."""
    keys, order = keys or ["symbol"], order or ["ts", "seq"]
    rest = [c for c in wide.columns if c not in keys]
    return wide.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
