"""Bars: parsing of raw exchange messages, aggregation to longer bars, and bars of ticks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.slicing import numbered

FIELDS = ("open", "high", "low", "close", "vol", "vol_ccy", "vol_ccy_quote")
_UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600}
#: Exchange channels by bar length in seconds.
CHANNELS = {60: "candle1m", 180: "candle3m", 300: "candle5m", 900: "candle15m", 1800: "candle30m", 3600: "candle1H", 7200: "candle2H", 14400: "candle4H"}


def parse_freq(freq: str) -> int:
    """Seconds of a bar length such as 5s, 1min or 2hr."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", freq)
    if not m or m[2].lower() not in _UNITS or int(m[1]) < 1:
        raise ValueError(f"not a bar length: {freq!r}")
    return int(m[1]) * _UNITS[m[2].lower()]


def resolve_source(freq: str) -> tuple[str, int]:
    """(channel, bars to merge): below a minute one-second candles are merged, else the channel has them."""
    seconds = parse_freq(freq)
    if seconds < 60:
        return "candle1s", seconds
    if seconds not in CHANNELS:
        raise ValueError(f"no channel has bars of {freq}")
    return CHANNELS[seconds], 1


def parse_candles(raw: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, ts_ms, seq, ts, fields, confirm) rows of candle messages; malformed messages have none."""
    message = F.from_json(column, "struct<arg:struct<channel:string,instId:string>,data:array<array<string>>>")
    rows = raw.select(message.alias("m")).select(F.col("m.arg.instId").alias("symbol"), F.posexplode("m.data").alias("seq", "d")).where(F.size("d") >= 9)
    number = lambda k: F.get("d", k).try_cast("double")
    return rows.select("symbol", F.get("d", 0).try_cast("long").alias("ts_ms"), F.col("seq").cast("long"), *(number(k + 1).alias(f) for k, f in enumerate(FIELDS)), (F.element_at("d", -1) == "1").alias("confirm")).withColumn("ts", F.timestamp_millis("ts_ms"))


def confirmed(candles: DataFrame) -> DataFrame:
    return candles.where("confirm").drop("confirm")


def parse_trades(raw: DataFrame, column: str = "json") -> DataFrame:
    """(symbol, ts, seq, px, sz, side); side is 1 for buy and -1 for all else."""
    message = F.from_json(column, "struct<arg:struct<channel:string,instId:string>,data:array<struct<px:string,sz:string,side:string,ts:string,tradeId:string>>>")
    rows = raw.select(message.alias("m")).select(F.col("m.arg.instId").alias("symbol"), F.posexplode("m.data").alias("seq", "d"))
    return rows.select("symbol", F.timestamp_millis(F.col("d.ts").try_cast("long")).alias("ts"), F.coalesce(F.col("d.tradeId").try_cast("long"), F.col("seq").cast("long")).alias("seq"), F.col("d.px").try_cast("double").alias("px"), F.col("d.sz").try_cast("double").alias("sz"), F.when(F.col("d.side") == "buy", 1.0).otherwise(-1.0).alias("side"))


def parse_books(raw: DataFrame, column: str = "json", levels: int = 5) -> DataFrame:
    """(symbol, ts, seq, bid_px, bid_sz, ask_px, ask_sz) with arrays of ``levels``; one-sided books are left out."""
    message = F.from_json(column, "struct<arg:struct<channel:string,instId:string>,data:array<struct<bids:array<array<string>>,asks:array<array<string>>,ts:string,seqId:long>>>")
    rows = raw.select(message.alias("m")).select(F.col("m.arg.instId").alias("symbol"), F.explode("m.data").alias("d")).where("size(d.bids) > 0 and size(d.asks) > 0")

    def side(name: str, k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.get(F.get(F.col(f"d.{name}"), i), F.lit(k)).try_cast("double"))

    return rows.select("symbol", F.timestamp_millis(F.col("d.ts").try_cast("long")).alias("ts"), F.col("d.seqId").alias("seq"), side("bids", 0).alias("bid_px"), side("bids", 1).alias("bid_sz"), side("asks", 0).alias("ask_px"), side("asks", 1).alias("ask_sz"))


def live_symbols(instruments: DataFrame) -> DataFrame:
    return instruments.where("state = 'live'").select("instId").orderBy("instId")


def _merge(order: Column, fields: list[str]) -> list[Column]:
    by = {"open": lambda: F.min_by("open", order), "high": lambda: F.max("high"), "low": lambda: F.min("low"), "close": lambda: F.max_by("close", order)}
    return [(by[f]() if f in by else F.sum(f)).alias(f) for f in fields]


def count_bars(candles: DataFrame, n: int, per_task: int | None = None) -> DataFrame:
    """Every n bars of a symbol in a row make one; a tail of fewer is withheld. Gaps are not filled.

    per_task numbers a symbol's rows in stretches of about so many rows, for symbols too long for one task.
    """
    if n < 1:
        raise ValueError("n must be positive")
    fields = [f for f in (*FIELDS, "volume") if f in candles.columns]
    if per_task:
        rows = numbered(candles, ["symbol"], ["ts", "seq"], per_task).withColumn("bar", F.floor(F.col("_row") / n))
    else:
        rows = candles.withColumn("bar", F.floor((F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "seq")) - 1) / n))
    out = rows.groupBy("symbol", "bar").agg(F.min("ts").alias("ts"), F.count("*").alias("_n"), *_merge(F.struct("ts", "seq"), fields))
    return out.where(F.col("_n") == n).drop("_n").withColumnRenamed("bar", "seq")


def time_bars(candles: DataFrame, freq: str) -> DataFrame:
    """Bars aligned to the clock: partial aggregates before the shuffle, no sort. Also runs on a stream."""
    fields = [f for f in (*FIELDS, "volume") if f in candles.columns]
    window = F.window("ts", f"{parse_freq(freq)} seconds")
    out = candles.groupBy("symbol", window.alias("w")).agg(*_merge(F.struct("ts", "seq"), fields))
    return out.select("symbol", F.col("w.start").alias("ts"), F.lit(0).cast("long").alias("seq"), *fields)


def with_returns(bars: DataFrame) -> DataFrame:
    """ret: close over the close before less 1; 0 for the first bar or after a close of 0."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts", "seq"))
    return bars.withColumn("ret", F.coalesce(F.when(before != 0, F.col("close") / before - 1.0), F.lit(0.0)))


def tick_bars(ticks: DataFrame, n: int = 2) -> DataFrame:
    """(symbol, seq, ts, open, high, low, close, volume, ret) from ticks (symbol, ts, seq, price, size), n to a bar."""
    one = ticks.select("symbol", "ts", "seq", *(F.col("price").alias(f) for f in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    return with_returns(count_bars(one, n))
