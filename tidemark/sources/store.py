"""Append-only tables of bars, trades and books, with the queries of a bounded cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.micro import last_rows
from tidemark.plans.planner import latest

#: Rows of a symbol that a snapshot shows.
WINDOWS = {"bars": 1000, "trades": 10_000, "books": 1000}


class Store:
    """A Parquet table, partitioned by symbol so that a filter on symbols reads only theirs."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bars", window: int | None = None):
        if kind not in WINDOWS:
            raise ValueError(f"kind must be one of {', '.join(WINDOWS)}")
        self.spark, self.path, self.window = spark, path, window or WINDOWS[kind]

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("symbol").parquet(self.path)

    def read(self, symbols: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if symbols is None else df.where(F.col("symbol").isin(symbols))

    def snapshot(self, symbols: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return last_rows(self.read(symbols), min(limit or self.window, self.window))

    def latest(self, symbols: list[str] | None = None) -> DataFrame:
        return latest(self.read(symbols))

    def write_ndjson(self, path: str, symbols: list[str] | None = None) -> None:
        """One JSON object a line, nulls too, for other tools."""
        self.read(symbols).write.mode("append").option("ignoreNullFields", "false").json(path)

    def counts(self) -> DataFrame:
        return self.read().groupBy("symbol").agg(F.count("*").alias("n"))
