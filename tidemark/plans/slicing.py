"""Long series in slices: a symbol's rows dealt to several tasks, each with the rows its first values look back on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.expr import Expr

#: Rows that a recursive average looks back, in spans: (1 - 2 / (t + 1)) ** (20 * t) is below 1e-17.
EMA_SPANS = 20


def lookback(e: Expr) -> int:
    """Rows before a bar that its value depends on; for ema those whose weight shows in a double."""
    if e.op == "ema_carry":
        raise ValueError("an average that carries over missing values looks back without bound")
    below = max((lookback(a) for a in e.args), default=0)
    if e.op == "ema":
        return below + (EMA_SPANS + 1) * e.window
    if e.op in ("autocorr_double", "ts_mad"):
        return below + 2 * e.window + e.lag
    return below + (e.window + e.lag if e.rolling else 0)


def _clock(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.cast("timestamp").cast("double") if dict(df.dtypes)[column].startswith("timestamp") else c.cast("double")


def numbered(df: DataFrame, keys: list[str], order: list[str], per_bucket: int) -> DataFrame:
    """df with _row, each row's number within its key from 0, without a sort of a whole key in one task.

    Rows are counted by stretches of the first order column, the counts are summed up, and rows are numbered
    within a stretch. The list of stretches is as long as rows / per_bucket.
    """
    clock = _clock(df, order[0])
    low, high, n = df.agg(F.min(clock), F.max(clock), F.count("*")).first()
    width = ((high or 0.0) - (low or 0.0)) / max(1, n // per_bucket) or 1.0
    df = df.withColumn("_stretch", F.coalesce(F.floor((clock - F.lit(low or 0.0)) / width), F.lit(-1)))
    counts = df.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(*order)) - 1
    starts = starts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_stretch"])), "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_stretch"])]
    joined = df.withColumn("_here", here).join(starts, same)
    return joined.withColumn("_row", F.col("_start") + F.col("_here")).select(*(c for c in df.columns if c != "_stretch"), "_row")


def sliced(df: DataFrame, exprs: Mapping[str, Expr], keys: list[str], order: list[str], rows: int) -> DataFrame:
    """df with _slice and _lead: slices of ``rows`` rows of a key, and marked copies of the rows before each."""
    back = max(lookback(e) for e in exprs.values())
    df = numbered(df, keys, order, max(1, rows // 4))
    own = F.floor(F.col("_row") / rows)
    # a row leads into every later slice that starts within ``back`` rows of it
    slices = F.sequence(own, F.floor((F.col("_row") + back) / rows))
    return df.withColumn("_own", own).withColumn("_slice", F.explode(slices)).withColumn("_lead", F.col("_slice") != F.col("_own")).drop("_own", "_row")
