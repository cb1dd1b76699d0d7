"""Price, volatility and liquidity features per symbol.

Windows cannot be nested, so the build is three selects: lags, rolling statistics of the lags, then
lags and rolling means of those statistics. All three use the same window specification.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from barloom.config import LOOKBACK_WINDOWS, MA_WINDOWS, TRADING_DAYS, VOL_WINDOWS
from barloom.functions import rolling as R
from barloom.functions.text import div, safe_div

#: Rows before its own that a feature of ``price_features`` can depend on: the longest mean and its slope's lag, or two nested windows.
LOOK_BACK = max(max(MA_WINDOWS) + 5, max(VOL_WINDOWS), 20 + 60) + 1

_HELPERS = ("_prev_close", "_delta", "_tr", "_illiq")

# The largest of the three ranges; greatest() skips the null ranges of a symbol's first bar.
TRUE_RANGE = f"greatest(high - low, abs(high - {R.lag('close')}), abs(low - {R.lag('close')}))"
DELTA = f"close - {R.lag('close')}"


def daily_returns(bars: DataFrame, out: str = "return_1d") -> DataFrame:
    return bars.selectExpr("*", f"{R.change('close', 1)} AS {out}")


def price_features(bars: DataFrame) -> DataFrame:
    """All price features; a later ``select`` of a few columns prunes the windows it does not need."""
    return _derived(_rolling(_lags(bars))).drop(*_HELPERS)


def _lags(bars: DataFrame) -> DataFrame:
    cols = [f"{R.lag('close')} AS _prev_close", f"{DELTA} AS _delta", f"{TRUE_RANGE} AS _tr"]
    for n in LOOKBACK_WINDOWS:
        cols.append(f"{R.change('close', n)} AS return_{n}d")
        cols.append(f"ln({div('close', R.lag('close', n))}) AS log_return_{n}d")
    cols += [f"{R.change('close', n)} AS momentum_{n}d" for n in (5, 10, 20)]
    out = bars.selectExpr("*", *cols)
    return out.selectExpr("*", f"{safe_div('abs(return_1d)', 'close * volume')} AS _illiq")


def _rolling(df: DataFrame) -> DataFrame:
    cols = [f"{R.std('return_1d', n)} AS volatility_{n}d" for n in VOL_WINDOWS]
    cols += [f"{R.mean('close', n)} AS ma_{n}" for n in MA_WINDOWS]
    for n in (14, 30):
        cols.append(f"100 - 100 / (1 + {safe_div(*R.gain_loss('_delta', n))}) AS rsi_{n}")
        cols.append(f"{R.mean('_tr', n)} AS atr_{n}")
    for n in (20, 50):
        cols += [f"{R.full('max', 'high', n)} AS high_{n}", f"{R.full('min', 'low', n)} AS low_{n}"]
    cols += [f"{R.mean('volume', n)} AS volume_ma_{n}" for n in (10, 20, 50)]
    cols.append(f"({R.mean('_illiq', 20)}) * 1e6D AS amihud_illiquidity")
    cols.append(f"{R.correlation('volume', 'abs(return_1d)', 20)} AS vol_ret_corr_20")
    return df.selectExpr("*", *cols)


def _derived(df: DataFrame) -> DataFrame:
    cols = [f"volatility_{n}d * {math.sqrt(TRADING_DAYS)!r}D AS realized_vol_{n}d" for n in VOL_WINDOWS]
    cols.append(f"{safe_div('volatility_5d', 'volatility_60d')} AS vol_term_structure")
    for n in MA_WINDOWS:
        before = R.lag(f"ma_{n}", 5)
        cols.append(f"{safe_div('close', f'ma_{n}')} AS ma_{n}_ratio")
        cols.append(f"{div(f'ma_{n} - {before}', before)} AS ma_{n}_slope")
    gap = div("open - _prev_close", "_prev_close")
    cols += [
        f"{div('high - low', 'open')} AS intraday_range_pct",
        f"{gap} AS overnight_gap_pct",
        f"{safe_div(f'abs({gap})', 'atr_14')} AS gap_vs_atr",
    ]
    for n in (20, 50):
        cols.append(f"{safe_div(f'close - low_{n}', f'high_{n} - low_{n}')} AS price_position_{n}")
    cols += [f"{safe_div('volume', f'volume_ma_{n}')} AS volume_ratio_{n}" for n in (10, 20, 50)]
    amihud_ma = R.mean("amihud_illiquidity", 60)
    cols += [
        f"{amihud_ma} AS amihud_ma_60",
        f"{safe_div('amihud_illiquidity', amihud_ma)} AS amihud_rel_60",
        f"{safe_div('high', 'low')} AS high_low_ratio",
        f"{safe_div('close', 'open')} AS close_open_ratio",
    ]
    return df.selectExpr("*", *cols)


def raw_rsi(gain: str, loss: str) -> str:
    """RSI by plain division: no loss gives 100, no move at all gives null."""
    return f"CASE WHEN {loss} = 0 AND {gain} > 0 THEN 100D ELSE 100 - 100 / (1 + {div(gain, loss)}) END"


def with_raw_rsi(bars: DataFrame, n: int, *extra: str) -> DataFrame:
    gain, loss = R.gain_loss("_delta", n)
    df = bars.selectExpr("*", f"{DELTA} AS _delta")
    df = df.selectExpr("*", f"{gain} AS _gain", f"{loss} AS _loss", *extra)
    return df.selectExpr("* EXCEPT (_delta, _gain, _loss)", f"{raw_rsi('_gain', '_loss')} AS rsi_{n}")


def rsi_extreme_signal(bars: DataFrame, n: int = 2, low: float = 10.0, high: float = 90.0) -> DataFrame:
    """RSI(n) with +1 below ``low`` and -1 above ``high``."""
    df = with_raw_rsi(bars, n)
    return df.selectExpr("*", f"CASE WHEN rsi_{n} < {low} THEN 1D WHEN rsi_{n} > {high} THEN -1D ELSE 0D END AS signal")
