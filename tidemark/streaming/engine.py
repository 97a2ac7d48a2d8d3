"""Factors over a stream of bars, with state for each symbol."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.arrow import evaluate, inputs_of
from tidemark.plans.expr import Expr
from tidemark.plans.slicing import lookback
from tidemark.sources.bars import FIELDS


log = logging.getLogger(__name__)


def _on_time(new: pd.DataFrame, last_ts: int | None, last_seq: int | None, late: Accumulator | None) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows of a micro-batch in (ts, seq) order without those no later than the last one taken, and their stamps."""
    new = new.sort_values(["ts", "seq"], kind="stable")
    stamp = new["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    if last_ts is None:
        return new, stamp
    missed = (stamp < last_ts) | (stamp == last_ts) & (new["seq"].to_numpy() <= last_seq)
    if late is not None and missed.any():
        late.add(int(missed.sum()))
    return new[~missed], stamp[~missed]


def stream_count_bars(candles: DataFrame, n: int, late: Accumulator | None = None) -> DataFrame:
    """Every n rows of a symbol in a row make one bar, over a stream; as ``count_bars`` does over a table.

    The state of a symbol is its unfinished bar of fewer than n rows, the number of the bar and the last row taken. Rows
    are taken in (ts, seq) order; one no later than the last came too late, is left out and counted in ``late``.
    """
    if n < 1:
        raise ValueError("n must be positive")
    fields = [f for f in (*FIELDS, "volume") if f in candles.columns]
    by = {"open": "first", "high": "max", "low": "min", "close": "last"}
    out = T.StructType([candles.schema["symbol"], T.StructField("seq", T.LongType()), candles.schema["ts"]] + [T.StructField(f, T.DoubleType()) for f in fields])
    state = T.StructType([T.StructField(c, T.LongType()) for c in ("bar", "ts", "seq")] + [T.StructField("stamps", T.ArrayType(T.LongType()))] + [T.StructField(f"in_{f}", T.ArrayType(T.DoubleType())) for f in fields])

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        bar, ts, seq, stamps, *rest = held.get if held.exists else (0, None, None, [], *([] for _ in fields))
        new, stamp = _on_time(pd.concat(list(batches)), ts, seq, late)
        if new.empty:
            return
        rows = pd.DataFrame({"ts": np.concatenate([np.array(stamps, np.int64), stamp])} | {f: np.concatenate([np.array(r, np.float64), new[f].to_numpy(np.float64)]) for f, r in zip(fields, rest, strict=True)})
        whole = len(rows) // n
        tail = rows.iloc[whole * n :]
        held.update((int(bar + whole), int(stamp[-1]), int(new["seq"].iloc[-1]), tail["ts"].tolist(), *(tail[f].tolist() for f in fields)))
        if whole:
            made = rows.iloc[: whole * n].groupby(np.arange(whole * n) // n).agg({"ts": "first"} | {f: by.get(f, "sum") for f in fields})
            stamped = made["ts"].to_numpy().astype("datetime64[us]")
            yield pd.DataFrame({"symbol": key[0], "seq": bar + np.arange(whole), "ts": stamped} | {f: made[f].to_numpy() for f in fields})

    wanted = candles.select("symbol", "ts", "seq", *(F.col(f).cast("double").alias(f) for f in fields))
    return wanted.groupBy("symbol").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_factors(bars: DataFrame, exprs: Mapping[str, Expr], raw: bool = False, late: Accumulator | None = None) -> DataFrame:
    """symbol, ts, seq and a column for each expression, for a streaming DataFrame of bars.

    The state of a symbol is its last rows, as many as the expressions look back on: bounded, whatever the
    length of the stream. Rows of a micro-batch are taken in (ts, seq) order; a row no later than the state's
    last one came too late, is left out and counted in ``late``. A new checkpoint resets the state.
    """
    exprs, names = dict(exprs), inputs_of(exprs)
    keep = max(lookback(e) for e in exprs.values())
    fields = [bars.schema["symbol"], bars.schema["ts"], bars.schema["seq"]]
    out = T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in exprs])
    state = T.StructType([T.StructField("ts", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType()))] + [T.StructField(f"in_{n}", T.ArrayType(T.DoubleType())) for n in names])

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = held.get if held.exists else ([], [], *([] for _ in names))
        new, stamp = _on_time(pd.concat(list(batches)), *((old[0][-1], old[1][-1]) if len(old[0]) else (None, None)), late)
        if new.empty:
            return
        before = len(old[0])
        columns = {n: np.concatenate([np.array(old[2 + k], np.float64), new[n].to_numpy(np.float64)]) for k, n in enumerate(names)}
        values = evaluate(exprs, columns)
        last = slice(-keep or None, None)
        held.update((np.concatenate([old[0], stamp]).astype(np.int64)[last].tolist(), np.concatenate([old[1], new["seq"]]).astype(np.int64)[last].tolist(), *(columns[n][last].tolist() for n in names)))
        made = {n: v[before:] if raw else np.where(np.isfinite(v[before:]), v[before:], 0.0) for n, v in values.items()}
        yield pd.DataFrame({"symbol": key[0], "ts": new["ts"].to_numpy(), "seq": new["seq"].to_numpy()} | made)

    wanted = bars.select("symbol", "ts", "seq", *(F.col(n).cast("double").alias(n) for n in names))
    return wanted.groupBy("symbol").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def ndjson_sink(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream's rows as one JSON object a line, each exactly once."""
    out = rows.writeStream.format("json").option("ignoreNullFields", "false").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names for checkpoints; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return f"{named.rstrip('/')}/tidemark-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="tidemark-stream-")


def replay(bars: DataFrame, exprs: Mapping[str, Expr], batches: int = 3) -> DataFrame:
    """Factors of history that is run through the stream in micro-batches."""
    return replay_through(bars, lambda source: stream_factors(source, exprs), batches)


def replay_through(bars: DataFrame, transform: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """History run through a streaming ``transform`` in ``batches`` micro-batches, cut by time; the sink's rows."""
    spark, at = bars.sparkSession, shared_folder(bars.sparkSession)
    low, high = bars.agg(F.min(F.col("ts").cast("timestamp").cast("double")), F.max(F.col("ts").cast("timestamp").cast("double"))).first()
    part = F.least(F.lit(batches - 1), F.floor((F.col("ts").cast("timestamp").cast("double") - (low or 0.0)) / max(1e-9, ((high or 0.0) - (low or 0.0)) / batches)))
    parts = bars.withColumn("_part", part).cache()
    query = None
    try:
        for k in range(batches):
            parts.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{at}/in")
            source = spark.readStream.schema(bars.schema).parquet(f"{at}/in")
            query = transform(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        parts.unpersist()
    return spark.read.parquet(f"{at}/out")


def evaluate_ticks(source: DataFrame, evaluate_batch, seconds: int, checkpoint: str):
    """Run ``evaluate_batch(df, tick_id)`` on a fixed schedule; a tick that fails is logged and left out."""

    def guarded(df: DataFrame, tick_id: int) -> None:
        try:
            evaluate_batch(df, tick_id)
        except Exception:
            log.exception("tick %s failed", tick_id)

    return source.writeStream.foreachBatch(guarded).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()
