"""Queries of the engine over the driver's tables, and their SQL.

``events`` stands in for market data: a symbol is an event type, ordered by (ts, event_id). The series x is the
value, y the user; bars are two ticks each, priced at the value, with sizes from the user. Outputs are rounded
to six digits on both sides, since engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cross, micro
from tidemark.functions.registry import FactorRegistry
from tidemark.operators import native
from tidemark.plans import oracle, planner
from tidemark.plans.describe import describe
from tidemark.plans.describe import rows as describe_rows
from tidemark.plans.expr import (
    Expr, abs_, autocorr, autocorr_double, close, corr, cov, delay, ema, inv, log, ma, neg, sign, slog1p, sqr, tanh, treap_ts_rank, ts_diff, ts_ir, ts_kurt, ts_mad, ts_mad_window, ts_max, ts_max_diff, ts_med, ts_min, ts_min_diff,
    ts_minmax_diff, ts_pct, ts_rank, ts_skew, ts_std, ts_sum, ts_vari, ts_wma, ts_zscore, volume, x, y,
)
from tidemark.sources import bars as bar_sources
from tidemark.sources.simulation import simulate
from tidemark.streaming.engine import replay, replay_through, stream_count_bars

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (F.col("user_id") % 50 + 1).cast("double").alias("size"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_sources.tick_bars(ticks(spark, sf_dir), 2)


SERIES = "series as (select event_type as symbol, ts, event_id as seq, value as x, user_id::double as y from events)"
TICKS = "ticks as (select event_type as symbol, ts, event_id as seq, value as price, (user_id % 50 + 1)::double as size from events)"
BARS = f"""{TICKS},
numbered as (select *, (row_number() over (partition by symbol order by ts, seq) - 1) // 2 as bar from ticks),
merged as (select symbol, min(ts) as ts, bar as seq, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, seq)) as close, sum(size) as volume
  from numbered group by symbol, bar having count(*) = 2),
bars as (select *, coalesce(case when lag(close) over w <> 0 then close / lag(close) over w - 1.0 end, 0.0) as ret from merged window w as (partition by symbol order by ts, seq))"""


def _rounded(df: DataFrame, names: list[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


def _add(name: str, exprs: dict[str, Expr], table: Callable, ctes: str, cte: str, strategy: str | None = None, digits: int = DIGITS) -> None:
    QUERIES[name] = lambda spark, d: _rounded(planner.compute(table(spark, d), exprs, strategy=strategy), list(exprs), digits)
    ORACLES[name] = oracle.select(cte, exprs, ctes=ctes, digits=digits)


#: One query for each operator, on series with both signs, zeros and ties.
_A, _B = x - 100.0, y / 10.0
_OPERATORS: dict[str, Expr] = {
    "neg": neg(x), "abs": abs_(_A), "log": log(_A), "sqr": sqr(_A), "inv": inv(x), "sign": sign(_A), "tanh": tanh(_A / 50.0), "slog1p": slog1p(_A),
    "add": x + y, "sub": x - y, "mul": x * y, "div": x / y, "add_scalar": x + 2.5, "sub_scalar": x - 2.5, "scalar_sub": 2.5 - x, "mul_scalar": x * 2.5, "div_scalar": x / 2.5, "scalar_div": 2.5 / x,
    "ma": ma(x, 30), "ts_sum": ts_sum(x, 30), "ts_std": ts_std(x, 30), "ts_vari": ts_vari(x, 30), "ema": ema(log(_A), 5), "ema_long": ema(x, 30), "ts_min": ts_min(x, 30), "ts_max": ts_max(x, 30), "ts_rank": ts_rank(x, 30),
    "ts_rank_long": ts_rank(x, 240), "treap_ts_rank": treap_ts_rank(x, 120), "ts_zscore": ts_zscore(x, 30), "delay": delay(x, 7), "ts_diff": ts_diff(x, 7), "ts_pct": ts_pct(x, 7),
    "corr": corr(x, y, 30), "autocorr": autocorr(x, 60, 5), "autocorr_double": autocorr_double(x, 30, 5), "ts_minmax_diff": ts_minmax_diff(log(_A), 30), "ts_skew": ts_skew(x, 30),
    "ts_med": ts_med(x, 30), "ts_mad": ts_mad(log(_A), 20), "ts_mad_window": ts_mad_window(x, 30), "ts_wma": ts_wma(x, 30), "ts_max_diff": ts_max_diff(log(_A), 30), "ts_min_diff": ts_min_diff(log(_A), 30),
    "ts_std_sample": ts_std(x, 30, 1), "ts_vari_sample": ts_vari(x, 30, 1),
    "ts_kurt": ts_kurt(x, 30), "cov": cov(x, y, 30), "ts_ir": ts_ir(log(_A), 30),
}
for _n, _e in _OPERATORS.items():
    _add(f"operator_{_n}", {"v": _e}, series, SERIES, "series")
for _n in ("ma", "ts_std", "ts_rank", "corr", "ts_skew", "ts_med", "ts_wma", "cov", "ts_kurt", "ts_mad", "autocorr_double"):
    _add(f"arrow_{_n}", {"v": _OPERATORS[_n]}, series, SERIES, "series", "arrow")
for _n in ("ma", "ts_rank", "ts_zscore", "corr", "autocorr", "ts_skew", "ts_kurt", "ts_med", "ts_mad", "cov", "ts_ir"):
    _add(f"native_{_n}", {"v": _OPERATORS[_n]}, series, SERIES, "series", "native")

#: Products of ranks are short decimals, and many lie halfway between two numbers of six digits.
_DIGITS = {"0003": 10, "0015": 10, "0019": 10, "0022": 10}
_registry = FactorRegistry().load_all()
for _n, _e in _registry.build_group("okx_perp").items():
    _add(f"factor_{_n}", {"v": _e}, bars, BARS, "bars", digits=_DIGITS.get(_n, DIGITS))


def factor_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All factors in one pass, in long form."""
    wide = planner.compute(bars(spark, sf_dir), {f"f_{k}": e for k, e in _registry.build_group("okx_perp").items()})
    long = planner.long_form(wide, [c for c in wide.columns if c.startswith("f_")])
    fine = F.col("factor_id").isin([f"f_{k}" for k in _DIGITS])
    return long.withColumn("value", F.when(fine, F.round("value", 10)).otherwise(F.round("value", DIGITS)) + 0.0)


QUERIES["factor_bank"] = factor_bank
ORACLES["factor_bank"] = " union all ".join(
    f"select symbol, ts, seq, 'f_{_n}' as factor_id, v as value from ({ORACLES[f'factor_{_n}']})" for _n in _registry.build_group("okx_perp")
)


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = {"v": _registry.build("0041")}
    return _rounded(planner.latest(planner.compute(bars(spark, sf_dir), e)), ["v"])


QUERIES["latest_factor"] = _latest
ORACLES["latest_factor"] = f"select symbol, arg_max(ts, (ts, seq)) as ts, arg_max(seq, (ts, seq)) as seq, arg_max(v, (ts, seq)) as v from ({ORACLES['factor_0041']}) group by symbol"

QUERIES["bars_count"] = lambda spark, d: bars(spark, d).withColumn("ret", F.round("ret", DIGITS) + 0.0)
ORACLES["bars_count"] = f"with {BARS} select symbol, seq, ts, open, high, low, close, volume, round(ret, {DIGITS}) + 0.0 as ret from bars"


def _time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = ticks(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "seq", *(F.col("price").alias(f) for f in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    return bar_sources.time_bars(one, "1h").withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("seq")


QUERIES["bars_time"] = _time_bars
ORACLES["bars_time"] = f"""with {TICKS} select symbol, date_trunc('hour', ts) as ts, arg_min(price, (ts, seq)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, seq)) as close, sum(size) as volume
from ticks group by symbol, date_trunc('hour', ts)"""


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as exchange messages and parsed again; one in seven is not confirmed."""
    t = ticks(spark, sf_dir)
    price = F.col("price").cast("string")
    row = F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), price, price, price, price, F.col("size").cast("string"), F.lit("0"), F.lit("0"), F.when(F.col("seq") % 7 == 0, "0").otherwise("1"))
    raw = t.select(F.to_json(F.struct(F.struct(F.lit("candle1s").alias("channel"), F.col("symbol").alias("instId")).alias("arg"), F.array(row).alias("data"))).alias("json"))
    return bar_sources.confirmed(bar_sources.parse_candles(raw)).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"), F.min("ts_ms").alias("first_ms"), F.sum("vol").alias("vol"))


QUERIES["candles_parsed"] = _candles
ORACLES["candles_parsed"] = f"with {TICKS} select symbol, count(*) as n, round(sum(price), 4) as total, min(epoch_us(ts) // 1000) as first_ms, sum(size) as vol from ticks where seq % 7 <> 0 group by symbol"


def _trades_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as trade messages and parsed again; a third of them are buys."""
    t = ticks(spark, sf_dir)
    side = F.when(F.col("seq") % 3 == 0, "buy").otherwise("sell")
    data = F.struct(F.col("price").cast("string").alias("px"), F.col("size").cast("string").alias("sz"), side.alias("side"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("seq").cast("string").alias("tradeId"))
    raw = t.select(F.to_json(F.struct(F.struct(F.lit("trades").alias("channel"), F.col("symbol").alias("instId")).alias("arg"), F.array(data).alias("data"))).alias("json"))
    got = bar_sources.parse_trades(raw).groupBy("symbol")
    return got.agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.round(F.sum(F.col("sz") * F.col("side")), 4).alias("net"), F.round(F.sum("px"), 4).alias("total"), F.min(F.unix_millis("ts")).alias("first_ms"))


QUERIES["trades_parsed"] = _trades_parsed
ORACLES["trades_parsed"] = f"""with {TICKS} select symbol, count(*) as n, max(seq) as last_seq, round(sum(size * case when seq % 3 = 0 then 1.0 else -1.0 end), 4) as net, round(sum(price), 4) as total,
min(epoch_us(ts) // 1000) as first_ms from ticks group by symbol"""


def _books_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks written as book messages of two levels and parsed again; one in seven has no asks and is left out."""
    t = ticks(spark, sf_dir)
    level = lambda shift: F.array((F.col("price") + shift).cast("string"), (F.col("size") + abs(shift)).cast("string"))
    asks = F.when(F.col("seq") % 7 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(level(1.0), level(2.0)))
    data = F.struct(F.array(level(-1.0), level(-2.0)).alias("bids"), asks.alias("asks"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts"), F.col("seq").alias("seqId"))
    raw = t.select(F.to_json(F.struct(F.struct(F.lit("books5").alias("channel"), F.col("symbol").alias("instId")).alias("arg"), F.array(data).alias("data"))).alias("json"))
    got = bar_sources.parse_books(raw).groupBy("symbol")
    third = F.sum(F.get("bid_px", 2).isNull().cast("long"))
    return got.agg(F.count("*").alias("n"), F.round(F.sum(F.get("ask_px", 1) - F.get("bid_px", 0)), 4).alias("spread"), F.sum(F.get("bid_sz", 1)).alias("second"), third.alias("without_third"))


QUERIES["books_parsed"] = _books_parsed
ORACLES["books_parsed"] = f"with {TICKS} select symbol, count(*) as n, round(sum((price + 2.0) - (price - 1.0)), 4) as spread, sum(size + 2.0) as second, count(*) as without_third from ticks where seq % 7 <> 0 group by symbol"


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = _time_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("value"))
    return _rounded(cross.rank(cross.zscore(hourly)).select("symbol", "ts", "zscore", "rank"), ["zscore", "rank"])


QUERIES["cross_section"] = _cross
ORACLES["cross_section"] = f"""with h as ({ORACLES['bars_time']}) select symbol, ts,
round(case when stddev_samp(close) over t >= 1e-10 then (close - avg(close) over t) / stddev_samp(close) over t else close * 0.0 end, {DIGITS}) + 0.0 as zscore,
round((rank() over (partition by ts order by close) + (count(close) over (partition by ts, close) - 1) / 2.0) / count(close) over t, {DIGITS}) + 0.0 as rank
from h window t as (partition by ts)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("sz"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0).alias("side"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir)
    got = micro.snapshot({"trades": t, "bars": t.withColumn("close", F.col("px"))}, (micro.TickFactor("momentum", "bars", 50, micro.bar_momentum), micro.TickFactor("imbalance", "trades", 100, micro.trade_imbalance)))
    return _rounded(got, ["momentum", "imbalance"])


QUERIES["tick_snapshot"] = _snapshot
ORACLES["tick_snapshot"] = f"""with t as (select l_returnflag as symbol, l_shipdate as ts, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as seq, l_extendedprice / l_quantity as px, l_quantity as sz, case when l_linestatus = 'O' then 1.0 else -1.0 end as side from lineitem),
r as (select *, row_number() over (partition by symbol order by ts desc, seq desc) as k from t)
select symbol, round(coalesce(arg_max(px, (ts, seq)) filter (k <= 50) / arg_min(px, (ts, seq)) filter (k <= 50) - 1.0, 0.0), {DIGITS}) + 0.0 as momentum,
round(sum(sz * side) filter (k <= 100) / sum(abs(sz)) filter (k <= 100), {DIGITS}) + 0.0 as imbalance from r group by symbol"""


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books made of five line items of an order: sizes from quantities, one level missing now and then."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"), F.max("l_shipdate").alias("ts"), F.min("l_returnflag").alias("symbol"))
    sizes = F.transform("q", lambda s: s["l_quantity"])
    books = rows.select("symbol", "ts", F.col("l_orderkey").alias("seq"), sizes.alias("bid_sz"), F.transform(sizes, lambda v: F.when(v % 5 != 0, v + 1.0)).alias("ask_sz"))
    return _rounded(micro.snapshot({"books": books}, tuple(f for f in micro.DEFAULTS if f.source == "books")), ["book_l1_imbalance", "book_l5_imbalance"])


QUERIES["book_snapshot"] = _books
ORACLES["book_snapshot"] = f"""with b as (select min(l_returnflag) as symbol, max(l_shipdate) as ts, l_orderkey as seq, list(l_quantity order by l_linenumber, l_quantity) as bid from lineitem group by l_orderkey),
a as (select *, list_transform(bid, lambda v: case when v % 5 <> 0 then v + 1.0 end) as ask from b),
l as (select * from a qualify row_number() over (partition by symbol order by ts desc, seq desc) = 1),
s as (select symbol, coalesce(bid[1], 0) as b1, coalesce(ask[1], 0) as a1, coalesce(list_sum(bid[1:5]), 0) as b5, coalesce(list_sum(ask[1:5]), 0) as a5 from l)
select symbol, round(coalesce(case when b1 + a1 <> 0 then (b1 - a1) / (b1 + a1) end, 0), {DIGITS}) + 0.0 as book_l1_imbalance,
round(coalesce(case when b5 + a5 <> 0 then (b5 - a5) / (b5 + a5) end, 0), {DIGITS}) + 0.0 as book_l5_imbalance from s"""

_SLICED = {"v": ts_zscore(ma(x, 20), 30)}
QUERIES["sliced_series"] = lambda spark, d: _rounded(planner.compute(series(spark, d), _SLICED, slice_rows=500), ["v"])
ORACLES["sliced_series"] = oracle.select("series", _SLICED, ctes=SERIES, digits=DIGITS)

_STREAMED = {"v": (x - ma(x, 20)) / ts_std(x, 20)}
QUERIES["stream_replay"] = lambda spark, d: _rounded(replay(series(spark, d), _STREAMED, batches=3), ["v"])
ORACLES["stream_replay"] = oracle.select("series", _STREAMED, ctes=SERIES, digits=DIGITS)


def _streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two ticks each, made over a stream of three micro-batches."""
    one = ticks(spark, sf_dir).select("symbol", "ts", "seq", *(F.col("price").alias(f) for f in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    return replay_through(one, lambda source: stream_count_bars(source, 2), batches=3).withColumn("symbol", F.col("symbol").cast("string"))


QUERIES["stream_count_bars"] = _streamed_bars
ORACLES["stream_count_bars"] = f"with {BARS} select symbol, seq, ts, open, high, low, close, volume from bars"

QUERIES["describe_factor"] = lambda spark, d: describe(spark, _registry.build("0012"))
ORACLES["describe_factor"] = "select * from (values " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v) for v in row) + ")" for row in describe_rows(_registry.build("0012"))) + ") t(id, op, input_a, input_b, \"window\", lag, value, is_output)"
QUERIES["simulated_bars"] = lambda spark, d: simulate(spark, ["BTC-USDT-SWAP", "ETH-USDT-SWAP"], 500, seed=7)

_READY = {"v": ts_zscore(close - ma(close, 10), 20), "w": volume / ts_max(volume, 5)}


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = planner.compute(bars(spark, sf_dir), _READY, raw=True, ready=True)
    return got.groupBy("symbol").agg(*(F.sum(F.col(f"{n}_ready").cast("long")).alias(f"{n}_rows") for n in _READY), F.round(F.sum(native.clean(F.col("w"))), 4).alias("w_total"))


QUERIES["factor_readiness"] = _ready
ORACLES["factor_readiness"] = f"""with f as ({oracle.select('bars', _READY, ctes=BARS, digits=None)}),
n as (select symbol, count(*) as n from f group by symbol)
select n.symbol, greatest(n - 28, 0)::bigint as v_rows, greatest(n - 4, 0)::bigint as w_rows, round(sum(w), 4) as w_total from n join f on f.symbol = n.symbol group by all"""
