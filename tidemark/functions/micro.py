"""Factors of one evaluation tick over bars, trades and books: aggregates of each symbol's last rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("bars", "trades", "books")


def last_rows(df: DataFrame, n: int, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Each key's last n rows. Spark keeps n rows for each key before the shuffle."""
    w = Window.partitionBy(*(keys or ["symbol"])).orderBy(*(F.col(c).desc() for c in order or ["ts", "seq"]))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _at() -> Column:
    return F.struct("ts", "seq")


def bar_momentum() -> Column:
    """Last close over first close less 1; 0 for fewer than two rows or a first close of 0."""
    first = F.min_by("close", _at())
    return F.coalesce(F.when((F.count("*") >= 2) & (first != 0), F.max_by("close", _at()) / first - 1.0), F.lit(0.0))


def trade_imbalance() -> Column:
    """Signed size over size; 0 if there is none."""
    total = F.sum(F.abs("sz"))
    return F.coalesce(F.when(total != 0, F.sum(F.col("sz") * F.col("side")) / total), F.lit(0.0))


def _levels(book: Column, field: str, n: int) -> Column:
    return F.aggregate(F.slice(book[field], 1, n), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def book_imbalance(levels: int) -> Column:
    """(bid - ask) / (bid + ask) sizes of the last book's first levels, missing ones left out; 0 if there are none."""
    book = F.max_by(F.struct("bid_sz", "ask_sz"), _at())
    bid, ask = _levels(book, "bid_sz", levels), _levels(book, "ask_sz", levels)
    return F.coalesce(F.when(bid + ask != 0, (bid - ask) / (bid + ask)), F.lit(0.0))


def of_array(fn: Callable[[np.ndarray], float], *fields: str) -> Callable[[], Column]:
    """A factor's value by a function of a (rows, fields) array, the window's rows in (ts, seq) order.

    A missing value is NaN, a result that isn't finite is taken as 0. The array has the factor's window of rows at most.
    """

    def value() -> Column:
        def run(ts: pd.Series, seq: pd.Series, *columns: pd.Series) -> float:
            rows = np.column_stack([c.to_numpy(np.float64) for c in columns])[np.lexsort((seq, ts))]
            got = float(fn(rows))
            return got if np.isfinite(got) else 0.0

        return F.pandas_udf(run, "double")("ts", "seq", *fields)

    return value


@dataclass(frozen=True)
class TickFactor:
    """An aggregate over the last ``window`` rows of a source."""

    name: str
    source: str
    window: int
    value: Callable[[], Column]

    def __post_init__(self) -> None:
        if self.source not in SOURCES:
            raise ValueError(f"source must be one of {', '.join(SOURCES)}")
        if self.window <= 0:
            raise ValueError("window must be positive")
        if not self.name:
            raise ValueError("a factor has a name")


DEFAULTS = (
    TickFactor("bar_momentum", "bars", 5, bar_momentum),
    TickFactor("trade_imbalance", "trades", 100, trade_imbalance),
    TickFactor("book_l1_imbalance", "books", 1, lambda: book_imbalance(1)),
    TickFactor("book_l5_imbalance", "books", 1, lambda: book_imbalance(5)),
)


def snapshot(sources: dict[str, DataFrame], factors: tuple[TickFactor, ...] = DEFAULTS, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, one column for each factor); a symbol that a source lacks has 0 for its factors."""
    out = None
    for f in factors:
        rows = sources.get(f.source)
        if rows is None:
            continue
        if symbols is not None:
            rows = rows.where(F.col("symbol").isin(symbols))
        one = last_rows(rows, f.window).groupBy("symbol").agg(f.value().alias(f.name))
        out = one if out is None else out.join(one, "symbol", "full")
    if out is None:
        raise ValueError("no source for any factor")
    return out.na.fill(0.0)


def snapshot_rows(wide: DataFrame, tick_id: int) -> DataFrame:
    """(tick_id, symbol, name, value)."""
    names = [c for c in wide.columns if c != "symbol"]
    return wide.unpivot("symbol", names, "name", "value").withColumn("tick_id", F.lit(tick_id).cast("long"))
