"""Values across symbols at one time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscore(df: DataFrame, value: str = "value", by: list[str] | None = None, out: str = "zscore") -> DataFrame:
    """(value - mean) / sample deviation over the rows of one ``by``; 0 where the deviation is missing or below 1e-10."""
    over = Window.partitionBy(*(by or ["ts"]))
    x = F.col(value)
    deviation = F.stddev_samp(x).over(over)
    return df.withColumn(out, F.when(deviation >= 1e-10, (x - F.avg(x).over(over)) / deviation).otherwise(x * 0.0))


def rank(df: DataFrame, value: str = "value", by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """Average rank of the value among the rows of one ``by``, as a share of their number; NULL for a missing value."""
    by = by or ["ts"]
    x = F.col(value)
    ordered = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = Window.partitionBy(*by, value)
    every = Window.partitionBy(*by)
    average = F.rank().over(ordered) + (F.count(x).over(ties) - 1) / 2.0
    return df.withColumn(out, F.when(x.isNotNull(), average / F.count(x).over(every)))
