"""One object to run factors over history or a stream of bars, and to ask for what it has."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.functions.micro import last_rows
from tidemark.functions.registry import FactorRegistry
from tidemark.plans import planner
from tidemark.plans.expr import Expr
from tidemark.sources.store import Store
from tidemark.streaming.engine import stream_factors


class SignalEngine:
    """Factors for named symbols. Rows of other symbols are left out before the shuffle."""

    def __init__(self, symbols: Iterable[str] = (), factors: Mapping[str, Expr] | None = None):
        self._symbols: list[str] = []
        self._factors: dict[str, Expr] = {}
        for s in symbols:
            self.add_symbol(s)
        for k, e in (factors or {}).items():
            self.add_factor(k, e)

    @classmethod
    def of_group(cls, group: str, symbols: Iterable[str]) -> SignalEngine:
        return cls(symbols, {f"f_{k}": e for k, e in FactorRegistry().load_group(group).build_group(group).items()})

    def add_symbol(self, symbol: str) -> None:
        if symbol in self._symbols:
            raise ValueError(f"symbol {symbol} is there already")
        self._symbols.append(symbol)

    def add_factor(self, factor_id: str, e: Expr) -> None:
        if factor_id in self._factors:
            raise ValueError(f"factor {factor_id} is there already")
        self._factors[factor_id] = e

    @property
    def symbols(self) -> list[str]:
        return list(self._symbols)

    @property
    def factor_ids(self) -> list[str]:
        return list(self._factors)

    def warmup(self) -> int:
        return max((e.warmup() for e in self._factors.values()), default=0)

    def _own(self, bars: DataFrame, unknown: str = "ignore") -> DataFrame:
        if not self._factors:
            raise ValueError("there are no factors")
        if unknown not in ("ignore", "error"):
            raise ValueError(f"unknown must be ignore or error, not {unknown!r}")
        ours = F.coalesce(F.col("symbol").isin(self._symbols), F.lit(False))
        if unknown == "error":
            ours = F.when(ours, True).otherwise(F.raise_error(F.concat(F.lit("unknown symbol "), F.coalesce("symbol", F.lit("NULL")))).cast("boolean"))
        return bars.where(ours)

    def run_batch(self, bars: DataFrame, unknown: str = "ignore", **options) -> DataFrame:
        """Factors of a table. Rows of unknown symbols are left out, or ("error") fail the query that meets them."""
        return planner.compute(self._own(bars, unknown), self._factors, **options)

    def run_stream(self, bars: DataFrame, raw: bool = False, unknown: str = "ignore") -> DataFrame:
        return stream_factors(self._own(bars, unknown), self._factors, raw)

    def latest(self, bars: DataFrame, **options) -> DataFrame:
        return planner.latest(self.run_batch(bars, **options))


class Engine:
    """Streams of bars, trades and books kept in stores, and the bars' factors beside them, under one folder that all
    executors see.

    Starting again with the same folder goes on where the last run ended, in a new process too. ``reset`` begins a new
    run, with a state, a store and factors of its own; the folders of earlier runs stay as they are.
    """

    def __init__(self, spark: SparkSession, engine: SignalEngine, folder: str, window: int | None = None, signals: int = 3):
        self.spark, self.engine, self.folder, self.signals = spark, engine, folder.rstrip("/"), signals
        self.window, self._queries = window, []
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs")
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._enter(max((int(f.getPath().getName()) for f in self._files.listStatus(path)), default=0) if self._files.exists(path) else 0)

    def _enter(self, run: int) -> None:
        self._run = run
        self.bars, self.trades, self.books = (Store(self.spark, f"{self.folder}/runs/{run}/{kind}", kind, self.window if kind == "bars" else None) for kind in ("bars", "trades", "books"))
        self._files.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/runs/{run}"))

    def start(self, bars: DataFrame, trades: DataFrame | None = None, books: DataFrame | None = None, **trigger) -> list[StreamingQuery]:
        """A query for each stream to its store, and one for the factors. trigger: as of ``DataStreamWriter.trigger``."""
        if any(q.isActive for q in self._queries):
            raise RuntimeError("it runs already")
        trigger = trigger or {"availableNow": True}

        def sink(df: DataFrame, name: str) -> StreamingQuery:
            return df.writeStream.format("parquet").partitionBy("symbol").option("path", f"{self.folder}/runs/{self._run}/{name}").option("checkpointLocation", f"{self.folder}/runs/{self._run}/state/{name}").trigger(**trigger).start()

        given = {"bars": bars, "factors": self.engine.run_stream(bars), "trades": trades, "books": books}
        self._queries = [sink(df, name) for name, df in given.items() if df is not None]
        return self._queries

    def wait(self) -> None:
        for q in self._queries:
            q.awaitTermination()

    def stop(self) -> None:
        for q in self._queries:
            q.stop()

    def reset(self) -> None:
        self.stop()
        self._enter(self._run + 1)

    def _outputs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs/{self._run}/factors")

    def get_data(self, symbols: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self.bars.snapshot(symbols, limit)

    def get_trade_data(self, symbols: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self.trades.snapshot(symbols, limit)

    def get_book_data(self, symbols: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return self.books.snapshot(symbols, limit)

    def output_by_id(self, factor_id: str, symbols: list[str] | None = None) -> DataFrame:
        """(symbol, value) of the latest bars; NULL for a factor that isn't there."""
        value = F.col(factor_id) if factor_id in self.engine.factor_ids else F.lit(None).cast("double")
        return self.get_factor_outputs(symbols).select("symbol", value.alias("value"))

    def get_factor_outputs(self, symbols: list[str] | None = None) -> DataFrame:
        """The latest values of each symbol."""
        out = self._outputs()
        return planner.latest(out if symbols is None else out.where(F.col("symbol").isin(symbols)))

    def signal_rows(self) -> DataFrame:
        """(symbol, ts, seq, bar_index, factor_id, value) of the last few bars of each symbol."""
        rows = last_rows(self._outputs(), self.signals)
        counts = self._outputs().groupBy("symbol").agg(F.count("*").alias("_all"))
        after = F.count("*").alias("_after")
        here = rows.alias("a").join(rows.select("symbol", F.struct("ts", "seq").alias("_at")).alias("b"), "symbol").where(F.col("_at") > F.struct("a.ts", "a.seq")).groupBy("symbol", "ts", "seq").agg(after)
        indexed = rows.join(counts, "symbol").join(here, ["symbol", "ts", "seq"], "left").withColumn("bar_index", F.col("_all") - F.coalesce("_after", F.lit(0))).drop("_all", "_after")
        return planner.long_form(indexed, self.engine.factor_ids, ["symbol", "ts", "seq", "bar_index"])

    @property
    def factor_ids(self) -> list[str]:
        return self.engine.factor_ids

    def bars_pushed(self) -> int:
        return self._outputs().count()

    def bar_count(self, symbol: str) -> int:
        return self.bars.read([symbol]).count()

    def trade_count(self, symbol: str) -> int:
        return self.trades.read([symbol]).count()

    def book_count(self, symbol: str) -> int:
        return self.books.read([symbol]).count()
