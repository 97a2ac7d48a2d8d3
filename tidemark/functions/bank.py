"""The bank of perpetual-swap factors, group okx_perp."""

from __future__ import annotations

from tidemark.functions.registry import register_factor
from tidemark.plans.expr import abs_, autocorr, close, corr, delay, ema, high, inv, log, low, ma, pct_change, ret, sign, slog1p, sqr, tanh, ts_diff, ts_max, ts_min, ts_rank, ts_std, ts_sum, ts_zscore, volume

GROUP = "okx_perp"
#: One-bar logarithmic return.
r1 = ts_diff(log(close), 1)

# Identifiers, compositions, windows and constants of the factors.
_FACTORS = {
    "0001": lambda: (close - ma(close, 120)) / ts_std(close, 60),
    "0002": lambda: (ts_diff(log(close), 30) / ts_std(r1, 120)) / -ts_rank(volume, 240),
    "0003": lambda: ts_rank((ts_diff(log(close), 15) / ts_std(r1, 60)), 240) * ts_rank((abs_(ts_diff(log(close), 15)) / slog1p(ma(volume, 30))), 240),
    "0004": lambda: -ts_rank(((ts_diff(log(close), 5) / ts_std(ts_diff(log(close), 5), 60)) * (abs_(ts_diff(log(close), 30)) / ts_sum(abs_(ts_diff(log(close), 5)), 6))), 180),
    "0005": lambda: ts_rank((-corr(r1, ts_diff(ema(log(volume), 5), 1), 120) * abs_(ts_zscore(ts_std(r1, 30), 360))), 240),
    "0007": lambda: -((ts_rank(ts_diff(log(close), 30), 240) - ts_rank((ma(volume, 30) / ma(volume, 120)), 240)) * ts_rank(ts_std(r1, 60), 360)),
    "0009": lambda: tanh((ts_zscore(((((close - ts_min(low, 30)) / (ts_max(high, 30) - ts_min(low, 30))) - 0.5) * (1.0 - ts_rank(((ts_max(high, 30) - ts_min(low, 30)) / close), 360))), 120) / 2.0)),
    "0010": lambda: -ts_rank((((close - ma(close, 10)) / ts_std(close, 60)) / slog1p((ma(volume, 5) / ma(volume, 120)))), 180),
    "0011": lambda: -ts_rank(corr(ts_diff(log(close), 5), ts_diff(slog1p(volume), 5), 60), 120) * ts_rank(ts_std(r1, 15), 120),
    "0012": lambda: -(ts_diff(log(close), 60) * ts_rank(((ts_std(close, 15) / ts_std(close, 240)) / slog1p((ma(volume, 15) / ma(volume, 240)))), 480)),
    "0013": lambda: ts_zscore(((ts_diff(log(close), 60) / ts_std(r1, 60)) * ts_rank((ts_std(r1, 30) / ts_std(r1, 240)), 120)), 180),
    "0014": lambda: -(ts_zscore(ts_diff(close, 60), 120) * ts_rank((ts_std(r1, 30) / ma(slog1p(volume), 30)), 240)),
    "0015": lambda: -((ts_rank(ma((((high - low) / close) / slog1p(volume)), 20), 240) - 0.5) * (ts_rank(ts_diff(log(close), 60), 360) - 0.5)),
    "0016": lambda: -((ts_rank((ma(volume, 60) / ma(volume, 360)), 360) / slog1p((ma(((high - low) / close), 30) / ma(((high - low) / close), 240)))) * ts_diff(log(close), 60)),
    "0018": lambda: -ts_zscore(ts_diff(ema((ema(r1, 20) / ema(slog1p(volume), 20)), 15), 45), 360),
    "0019": lambda: -(ts_rank((ma(r1, 10) - ma(r1, 60)), 240) * ts_rank((volume / ma(volume, 120)), 240)),
    "0020": lambda: -ts_zscore(((((close - ts_min(low, 120)) / (ts_max(high, 120) - ts_min(low, 120))) - 0.5) * (ma(volume, 15) / ma(volume, 120))), 240),
    "0022": lambda: ts_rank(((ts_max(high, 15) - ts_min(low, 15)) / (close * ts_std(r1, 120))), 120) * (ts_rank(ts_zscore(ts_diff(log(close), 30), 180), 120) * ts_rank((ma(volume, 10) / ma(volume, 60)), 120)),
    "0023": lambda: -ts_rank((ts_sum((volume * ret), 30) / ts_sum(abs_((volume * ret)), 180)), 360),
    "0024": lambda: -((ts_diff(log(close), 20) / ts_std(r1, 20)) / ma(ts_std(r1, 120), 30)),
    "0025": lambda: -((ts_zscore(ts_diff(log(close), 15), 120) * ((close - ts_min(low, 60)) / (ts_max(high, 60) - ts_min(low, 60)))) * (ts_std(r1, 30) / ts_std(r1, 240))),
    "0026": lambda: -tanh(ts_zscore(ts_sum((r1 * slog1p(volume)), 60), 360)),
    "0028": lambda: (ts_diff(log(close), 60) * -ts_rank((abs_(ts_diff(close, 120)) / ts_sum(abs_(ts_diff(close, 1)), 120)), 240)) * ts_rank(ma((sqr(r1) * (volume / ma(volume, 120))), 30), 240),
    "0029": lambda: -(((ts_diff(log(close), 15) - (ts_diff(log(close), 45) / 3.0)) / ts_std(r1, 120)) * ts_rank(volume, 120)),
    "0050": lambda: -corr(ts_rank(pct_change(close, 1), 30), ts_rank(volume, 30), 120),
    "0100": lambda: -(ma((ts_rank(close, 180) - ts_rank(volume, 180)), 30) / ts_std((ts_rank(close, 180) - ts_rank(volume, 180)), 360)),
    "0031": lambda: -ts_rank(tanh((ts_zscore(ma(ret, 30), 360) * corr(abs_(ret), volume, 120))), 240),
    "0032": lambda: ts_diff(log(close), 30) * (1.0 - ts_rank((((high - low) / close) / slog1p(ma(volume, 5))), 240)),
    "0033": lambda: -((ts_rank((abs_(ts_diff(log(close), 30)) / ts_std(r1, 30)), 720) * ts_rank((ma(volume, 30) / ma(volume, 240)), 720)) * sign(ts_diff(close, 30))),
    "0034": lambda: -(ts_zscore(ts_diff(log(close), 60), 120) * (inv((ts_std(r1, 30) / ts_std(r1, 240))) * corr(abs_(r1), slog1p(volume), 60))),
    "0035": lambda: (ema(close, 10) - ema(close, 60)) / ts_std(close, 60),
    "0036": lambda: ts_zscore(slog1p(volume), 120),
    "0037": lambda: -ts_zscore(((high - low) / ma(close, 30)), 120),
    "0038": lambda: -autocorr(r1, 60, 5),
    "0039": lambda: -ts_rank((r1 * slog1p(volume)), 60),
    "0040": lambda: -(ts_std(r1, 15) / ts_std(r1, 120)),
    "0041": lambda: (close - ma(close, 60)) / ts_std(close, 60),
    "0042": lambda: -corr(ts_diff(log(close), 5), slog1p(volume), 60),
    "0043": lambda: ((close - ts_min(low, 60)) / (ts_max(high, 60) - ts_min(low, 60))) - 0.5,
    "0044": lambda: ts_zscore((abs_(ts_diff(close, 1)) / (high - low)), 60),
    "0045": lambda: -ts_rank(ts_diff(log(close), 30), 120),
    "0046": lambda: ((close - ema(close, 30)) / ema(close, 30)) * ts_rank(volume, 30),
    "0047": lambda: -(ts_sum(abs_(r1), 30) / abs_(ts_diff(log(close), 30))),
    "0048": lambda: ts_min(r1, 60) / -ts_max(r1, 60),
    "0049": lambda: (ts_std(ts_diff(close, 10), 30) / (ts_std(ts_diff(close, 1), 30) * 3.162)) - 1.0,
    "0051": lambda: ts_rank(close, 60) - ts_rank(volume, 60),
    "0052": lambda: ts_zscore(ema(r1, 10), 120),
    "0053": lambda: -ts_zscore(ts_std(slog1p(volume), 30), 120),
    "0054": lambda: (close - ts_max(high, 30)) / ts_std(close, 30),
    "0055": lambda: -(ts_diff(log(close), 5) * (ma(volume, 5) / ma(volume, 60))),
    "0056": lambda: -ts_rank(((close - low) / (high - low)), 60),
    "0057": lambda: ts_diff(log(close), 5) - delay(ts_diff(log(close), 5), 10),
    "0058": lambda: -corr(ts_rank(abs_(r1), 30), ts_rank(volume, 30), 60),
    "0059": lambda: ts_zscore((ema(close, 10) / ema(close, 120)), 60),
    "0060": lambda: ts_zscore((sign(ts_diff(close, 1)) * slog1p(volume)), 60),
    "0061": lambda: ma(r1, 30) / ts_std(r1, 30),
    "0062": lambda: -ts_rank(ts_std(r1, 15), 120),
    "0063": lambda: ts_diff(ts_diff(log(close), 10), 10),
    "0064": lambda: -corr(ma(close, 10), ma(volume, 10), 120),
    "0065": lambda: -ts_zscore((r1 * ((high - low) / close)), 60),}

for _id, _build in _FACTORS.items():
    register_factor(GROUP, _id)(_build)
