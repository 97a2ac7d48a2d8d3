"""Synthetic bars: a seeded geometric walk for each symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default symbols and their base prices; another symbol starts at 100 unless a price is given.
BASE_PRICES = {"BTC-USDT-SWAP": 85000.0, "ETH-USDT-SWAP": 3000.0, "SOL-USDT-SWAP": 150.0, "DOGE-USDT-SWAP": 0.15, "XRP-USDT-SWAP": 0.55}
SCHEMA = "symbol string, seq long, ts_ms long, open double, high double, low double, close double, vol double, vol_ccy double, vol_ccy_quote double"


def simulate(spark: SparkSession, symbols: list[str], n: int, seed: int = 0, sigma: float = 0.001, base_volume: float = 100.0, start_ms: int = 0, step_ms: int = 1000, prices: dict[str, float] | None = None) -> DataFrame:
    """n bars for each symbol. Symbol k draws from seed + k, so results don't depend on partitions."""
    prices = BASE_PRICES | (prices or {})
    rows = spark.createDataFrame([(s, k) for k, s in enumerate(symbols)], "symbol string, k long")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, k = pdf["symbol"].iloc[0], int(pdf["k"].iloc[0])
        rng = np.random.default_rng(seed + k)
        close = prices.get(symbol, 100.0) * np.exp(np.cumsum(rng.normal(0, sigma, n)))
        open_ = np.concatenate([[prices.get(symbol, 100.0)], close[:-1]])
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, sigma / 2, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, sigma / 2, n)))
        vol = base_volume * (1 + np.abs(rng.normal(0, 0.3, n)))
        return pd.DataFrame({"symbol": symbol, "seq": np.arange(n), "ts_ms": start_ms + step_ms * np.arange(n), "open": open_, "high": high, "low": low, "close": close, "vol": vol, "vol_ccy": vol * close, "vol_ccy_quote": vol * close})

    return rows.groupBy("symbol").applyInPandas(walk, SCHEMA).withColumn("ts", F.timestamp_millis("ts_ms"))
