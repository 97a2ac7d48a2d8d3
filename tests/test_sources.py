"""Bars, messages, tick factors, the cross-section, the store and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cross, micro
from tidemark.plans import planner
from tidemark.plans.expr import close, ema, ma, ts_std
from tidemark.sources import bars as B
from tidemark.sources.simulation import simulate
from tidemark.sources.store import Store
from tidemark.streaming.engine import evaluate_ticks, replay, stream_count_bars, stream_factors


def candle(symbol, ts, o, h, low, c, v, confirm="1"):
    return json.dumps({"arg": {"channel": "candle1s", "instId": symbol}, "data": [[str(ts), str(o), str(h), str(low), str(c), str(v), str(v * 2), str(v * 3), confirm]]})


@pytest.fixture(scope="module")
def candles(spark):
    """Twelve seconds, two of them not confirmed, one missing."""
    rows = [candle("A", 1000 * k, k, k + 2, k - 1, k + 1, 10, "0" if k in (3, 8) else "1") for k in range(13) if k != 6]
    return B.confirmed(B.parse_candles(spark.createDataFrame([(r,) for r in [*rows, "not json", "{}"]], "json string")))


def test_candles(candles):
    assert candles.count() == 10
    assert candles.orderBy("ts_ms").first()["open"] == 0.0


def test_count_bars_withhold_a_tail(candles):
    got = B.count_bars(candles, 4).orderBy("seq").collect()
    assert [(r.open, r.high, r.low, r.close, r.vol) for r in got] == [(0.0, 6.0, -1.0, 5.0, 40.0), (5.0, 12.0, 4.0, 11.0, 40.0)]
    assert [tuple(r) for r in B.count_bars(candles, 4, per_task=2).orderBy("seq").collect()] == [tuple(r) for r in B.count_bars(candles, 4).orderBy("seq").collect()]
    with pytest.raises(ValueError):
        B.count_bars(candles, 0)


def test_time_bars(candles):
    got = {r.ts.second: (r.open, r.close, r.vol) for r in B.time_bars(candles, "5s").collect()}
    assert got == {0: (0.0, 5.0, 40.0), 5: (5.0, 10.0, 30.0), 10: (10.0, 13.0, 30.0)}


def test_lengths():
    assert [B.parse_freq(f) for f in ("5s", "1min", "2HR", " 3 m ")] == [5, 60, 7200, 180]
    for bad in ("5", "s", "0s", "5 days", "-1s"):
        with pytest.raises(ValueError):
            B.parse_freq(bad)
    assert B.resolve_source("15s") == ("candle1s", 15) and B.resolve_source("1h") == ("candle1H", 1)
    with pytest.raises(ValueError):
        B.resolve_source("7min")


def test_returns(spark):
    df = spark.createDataFrame([("A", k, k, c) for k, c in enumerate([2.0, 4.0, 0.0, 5.0])], "symbol string, ts long, seq long, close double")
    assert [r.ret for r in B.with_returns(df).orderBy("seq").collect()] == [0.0, 1.0, -1.0, 0.0]


def test_trades_and_books(spark):
    trades = [{"arg": {"channel": "trades", "instId": "A"}, "data": [{"px": "10", "sz": "3", "side": "buy", "ts": "1000", "tradeId": "1"}, {"px": "11", "sz": "1", "side": "sell", "ts": "1001", "tradeId": "2"}, {"px": "11", "sz": "0", "side": "?", "ts": "1002", "tradeId": "3"}]}]
    t = B.parse_trades(spark.createDataFrame([(json.dumps(x),) for x in trades], "json string"))
    books = [
        {"arg": {"channel": "books5", "instId": "A"}, "data": [{"bids": [["9", "4"], ["8", "2"], ["7", "2"]], "asks": [["10", "1"], ["11", "1"]], "ts": "5", "seqId": 2}]},
        {"arg": {"channel": "books5", "instId": "A"}, "data": [{"bids": [], "asks": [["10", "1"]], "ts": "6", "seqId": 3}]},
    ]
    b = B.parse_books(spark.createDataFrame([(json.dumps(x),) for x in books], "json string"))
    assert b.count() == 1 and b.first()["bid_px"] == [9.0, 8.0, 7.0, None, None]
    bars = spark.createDataFrame([("A", k, k, c) for k, c in enumerate([2.0, 3.0])] + [("B", 0, 0, 1.0)], "symbol string, ts long, seq long, close double")
    got = {r.symbol: r for r in micro.snapshot({"trades": t, "books": b, "bars": bars}).collect()}
    assert (got["A"].bar_momentum, got["A"].trade_imbalance, got["A"].book_l1_imbalance, got["A"].book_l5_imbalance) == (0.5, 0.5, 0.6, 0.6)
    assert (got["B"].bar_momentum, got["B"].trade_imbalance) == (0.0, 0.0)
    assert micro.snapshot_rows(micro.snapshot({"bars": bars}), 7).count() == 2
    for bad in (("x", "other", 5), ("x", "bars", 0), ("", "bars", 5)):
        with pytest.raises(ValueError):
            micro.TickFactor(*bad, micro.bar_momentum)


def test_live_symbols(spark):
    df = spark.createDataFrame([("b", "live"), ("a", "live"), ("c", "suspend")], "instId string, state string")
    assert [r.instId for r in B.live_symbols(df).collect()] == ["a", "b"]


def test_cross_section(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 3.0), (1, None), (2, 5.0), (3, 4.0), (3, 4.0)], "ts int, value double")
    got = [tuple(r) for r in cross.rank(cross.zscore(df)).orderBy("ts", F.col("value").asc_nulls_last()).collect()]
    assert [None if r[3] is None else round(r[3], 6) for r in got] == [0.333333, 0.833333, 0.833333, None, 1.0, 0.75, 0.75]
    assert [r[2] for r in got][4:] == [0.0, 0.0, 0.0] and abs(got[0][2] + 1.154700538) < 1e-8


def test_simulation_is_reproducible(spark):
    a, b = (simulate(spark, ["BTC-USDT-SWAP", "Q"], 50, seed=3).orderBy("symbol", "seq").toPandas() for _ in range(2))
    assert a.equals(b) and (a["high"] >= a[["open", "close"]].max(axis=1)).all() and (a["low"] <= a[["open", "close"]].min(axis=1)).all()
    q = a[a["symbol"] == "Q"]
    assert q["open"].iloc[0] == 100.0 and np.array_equal(q["open"].to_numpy()[1:], q["close"].to_numpy()[:-1])


def test_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/bars", "bars", window=10)
    s.append(simulate(spark, ["A", "B"], 30, seed=1))
    assert s.snapshot().count() == 20 and s.snapshot(["A"], 5).count() == 5
    assert {r.seq for r in s.latest().collect()} == {29} and {r.n for r in s.counts().collect()} == {30}


def test_stream_equals_batch(spark):
    e = {"a": (close - ma(close, 7)) / ts_std(close, 7), "b": ema(close, 5)}
    bars = simulate(spark, ["A", "B"], 200, seed=2).select("symbol", "ts", "seq", "close").cache()
    whole = planner.compute(bars, e).toPandas().sort_values(["symbol", "seq"])
    got = replay(bars, e, batches=4).toPandas().sort_values(["symbol", "seq"])
    assert len(got) == len(whole) == 400
    for c in e:
        assert np.allclose(got[c], whole[c], rtol=1e-9, atol=1e-12), c


def test_streaming_bars(spark, tmp_path):
    simulate(spark, ["A"], 20, seed=2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 second")
    q = B.time_bars(source, "5s").writeStream.format("memory").queryName("bars5").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bars5").count() >= 3
    assert stream_factors(source, {"v": ma(close, 3)}).isStreaming


def test_engine(spark, tmp_path):
    from tidemark.streaming.facade import Engine, SignalEngine

    e = SignalEngine(["A"], {"m": ma(close, 3)})
    for bad in (lambda: e.add_symbol("A"), lambda: e.add_factor("m", close), lambda: SignalEngine(["A"]).run_batch(simulate(spark, ["A"], 3))):
        with pytest.raises(ValueError):
            bad()
    assert len(SignalEngine.of_group("okx_perp", ["A"]).factor_ids) == 60 and e.warmup() == 3
    bars = simulate(spark, ["A", "B"], 40, seed=9)
    bars.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/in")
    run = Engine(spark, e, f"{tmp_path}/engine", window=10)
    run.start(source)
    run.wait()
    assert run.bars_pushed() == 40 and run.bar_count("B") == 40 and run.get_data().count() == 20
    last = e.latest(bars).first()
    assert run.get_factor_outputs().first()["m"] == pytest.approx(last["m"]) and run.get_factor_outputs(["B"]).count() == 0
    assert sorted(r.bar_index for r in run.signal_rows().collect()) == [38, 39, 40]
    run.reset()
    more = simulate(spark, ["A", "B"], 60, seed=9)
    more.coalesce(1).write.parquet(f"{tmp_path}/more")
    again = Engine(spark, e, f"{tmp_path}/engine", window=10)  # another process would find the run too
    for r in (run, again):
        r.start(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/more"))
        r.wait()
        assert r.bars_pushed() == 60 and r.bar_count("A") == r.bar_count("B") == 60
        r.stop()


def test_count_bars_of_a_stream(spark, tmp_path):
    rows = simulate(spark, ["A", "B"], 23, seed=4).select("symbol", "ts", "seq", "open", "high", "low", "close", "vol").cache()
    want = sorted(map(tuple, B.count_bars(rows, 5).select("symbol", "seq", "ts", "open", "high", "low", "close", "vol").collect()))
    late = spark.sparkContext.accumulator(0)
    for lo, hi in ((0, 7), (7, 8), (8, 23)):
        rows.where(f"seq >= {lo} and seq < {hi} or seq = 2 and {lo} = 8").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        stream_count_bars(source, 5, late).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("symbol", "seq", "ts", "open", "high", "low", "close", "vol").collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 8
    assert all(a[3:] == pytest.approx(b[3:]) for a, b in zip(got, want, strict=True))
    assert late.value == 2  # the third row of both, once more


def test_a_failing_tick_is_left_out(spark, tmp_path):
    simulate(spark, ["A"], 4, seed=2).repartition(3).write.option("maxRecordsPerFile", 2).parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def tick(df, number):
        seen.append(number)
        if number == 0:
            raise RuntimeError("once")

    q = evaluate_ticks(source, tick, 0, f"{tmp_path}/c")
    q.processAllAvailable()
    assert q.isActive and len(seen) >= 2 and len(set(seen)) == len(seen)
    q.stop()


def test_engine_of_trades_and_books(spark, tmp_path):
    from tidemark.streaming.engine import ndjson_sink
    from tidemark.streaming.facade import Engine, SignalEngine

    bars = simulate(spark, ["A", "B"], 12, seed=9)
    trades = spark.createDataFrame([(s, k, k, 10.0 + k, 1.0, 1.0) for s in "AB" for k in range(7)], "symbol string, ts long, seq long, px double, sz double, side double")
    books = spark.createDataFrame([("A", k, k, [1.0], [2.0], [3.0], [None]) for k in range(5)], "symbol string, ts long, seq long, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>")
    streams = {}
    for name, df in (("bars", bars), ("trades", trades), ("books", books)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        streams[name] = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
    e = SignalEngine(["A"], {"m": ma(close, 3)})
    run = Engine(spark, e, f"{tmp_path}/engine")
    run.start(**streams)
    run.wait()
    assert (run.trade_count("A"), run.book_count("A"), run.book_count("B"), run.bar_count("B")) == (7, 5, 0, 12)
    assert run.get_trade_data(["B"], 3).count() == 3 and {r.seq for r in run.get_book_data(limit=2).collect()} == {3, 4}
    assert run.output_by_id("none").first()["value"] is None and run.output_by_id("m").first()["value"] == run.get_factor_outputs().first()["m"]
    run.trades.write_ndjson(f"{tmp_path}/lines", ["A"])
    assert spark.read.json(f"{tmp_path}/lines").count() == 7
    for _ in range(2):  # a second run of the sink writes nothing twice
        ndjson_sink(streams["books"], f"{tmp_path}/json", f"{tmp_path}/json_state").awaitTermination()
    assert sorted(r.seq for r in spark.read.json(f"{tmp_path}/json").collect()) == [0, 1, 2, 3, 4]
    assert e.run_batch(bars).count() == 12
    with pytest.raises(Exception, match="unknown symbol B"):
        e.run_batch(bars, unknown="error").count()
    with pytest.raises(ValueError):
        e.run_batch(bars, unknown="other")


def test_factor_of_an_array(spark):
    rows = spark.createDataFrame([("A", k, k, float(k), 2.0) for k in range(10)] + [("B", 0, 0, float("nan"), 1.0)], "symbol string, ts long, seq long, px double, sz double").repartition(3)
    last = micro.TickFactor("slope", "trades", 4, micro.of_array(lambda a: a[-1, 0] - a[0, 0] + len(a) * a[0, 1], "px", "sz"))
    got = {r.symbol: r.slope for r in micro.snapshot({"trades": rows}, (last,)).collect()}
    assert got == {"A": 3.0 + 4 * 2.0, "B": 0.0}


def test_registry_scans_a_package(tmp_path, monkeypatch):
    from tidemark.functions import registry
    from tidemark.functions.registry import FactorRegistry

    monkeypatch.setattr(registry, "_registered", dict(registry._registered))  # other tests count what is registered
    (tmp_path / "plugged" / "deep").mkdir(parents=True)
    for f in ("__init__.py", "deep/__init__.py"):
        (tmp_path / "plugged" / f).write_text("")
    (tmp_path / "plugged" / "deep" / "one.py").write_text("from tidemark.functions.registry import register_factor\nfrom tidemark.plans.expr import close\nregister_factor('plugged', '9001')(lambda: close)\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    for _ in range(2):
        assert FactorRegistry().load_package("plugged").factor_ids() == ["9001"]
