"""Forward-looking regime labels, the safety lattice, and the rule signals built on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barloom.config import FAVORABLE, HOSTILE, NEUTRAL, RESEARCH, TRADING_DAYS
from barloom.functions import rolling as R
from barloom.functions.sliding import rolling_quantiles
from barloom.functions.text import div
from barloom.operators.price import TRUE_RANGE, with_raw_rsi


def adx(bars: DataFrame, n: int = 14, out: str = "adx") -> DataFrame:
    """Simple-mean ADX: directional moves, directional indices, then the mean of their contrast."""
    df = bars.selectExpr(
        "*", f"{TRUE_RANGE} AS _tr", f"high - {R.lag('high')} AS _up", f"{R.lag('low')} - low AS _down"
    )
    plus = "IF(_up > _down AND _up > 0, _up, 0D)"
    minus = "IF(_down > _up AND _down > 0, _down, 0D)"
    atr = R.mean("_tr", n)
    df = df.selectExpr(
        "* EXCEPT (_tr, _up, _down)",
        f"100 * {div(R.mean(plus, n), atr)} AS _pdi",
        f"100 * {div(R.mean(minus, n), atr)} AS _mdi",
    )
    df = df.selectExpr(
        "* EXCEPT (_pdi, _mdi)", "100 * abs(_pdi - _mdi) / IF(_pdi + _mdi = 0, 1D, _pdi + _mdi) AS _dx"
    )
    return df.selectExpr("* EXCEPT (_dx)", f"coalesce({R.mean('_dx', n)}, 0D) AS {out}")


def forward_metrics(bars: DataFrame, horizon: int = RESEARCH.horizon) -> DataFrame:
    """Volatility, drawdown, trend strength and illiquidity over the next ``horizon`` bars."""
    df = adx(bars).selectExpr("*", f"{R.change('close', 1)} AS _ret")
    illiq = div("abs(_ret)", "close * volume")
    df = df.selectExpr(
        "* EXCEPT (_ret)",
        f"{R.std('_ret', horizon)} AS _vol",
        f"{R.full('min', 'low', horizon)} AS _low",
        f"{R.mean(illiq, horizon)} AS _amihud",
    )
    return df.selectExpr(
        "* EXCEPT (adx, _vol, _low, _amihud)",
        f"{R.lead('_vol', horizon)} * {math.sqrt(TRADING_DAYS)!r}D AS future_vol",
        f"{div(R.lead('_low', horizon) + ' - close', 'close')} AS future_drawdown",
        f"{R.lead('adx', horizon)} AS future_adx",
        f"{R.lead('_amihud', horizon)} AS future_amihud",
    )


def rolling_threshold(df: DataFrame, specs: dict[str, tuple[str, float]], n: int = TRADING_DAYS) -> DataFrame:
    """Rolling quantiles, filled backwards over the warm-up rows: ``{output: (column, quantile)}``; one sliding pass for all."""
    return rolling_quantiles(df, specs, n, fill_back=True)


def label_regimes(bars: DataFrame, horizon: int = RESEARCH.horizon, lookback: int = TRADING_DAYS) -> DataFrame:
    """Volatility, trend and liquidity labels; a comparison with a missing value gives 0."""
    df = rolling_threshold(
        forward_metrics(bars, horizon),
        {
            "vol_threshold": ("future_vol", RESEARCH.vol_quantile),
            "liq_threshold": ("future_amihud", RESEARCH.liq_quantile),
        },
        lookback,
    )
    return df.selectExpr(
        "* EXCEPT (future_vol, future_drawdown, future_adx, future_amihud, vol_threshold, liq_threshold)",
        "IF(coalesce(future_vol > vol_threshold, false) OR coalesce(future_drawdown < -0.05D, false), 1, 0) AS regime_vol",
        f"IF(future_adx > {RESEARCH.adx_threshold}, 1, 0) AS regime_trend",
        "IF(future_amihud > liq_threshold, 1, 0) AS regime_liq",
    )


def lattice(df: DataFrame, vol: str = "regime_vol", trend: str = "regime_trend", liq: str = "regime_liq") -> DataFrame:
    """Safety first: hostile when risky or illiquid, favourable when trending, else neutral."""
    hostile, trending = f"{vol} = 1 OR {liq} = 1", f"{trend} = 1"
    return df.selectExpr(
        "*",
        f"CASE WHEN {hostile} THEN {HOSTILE} WHEN {trending} THEN {FAVORABLE} ELSE {NEUTRAL} END AS lattice_state",
        f"CASE WHEN {hostile} THEN 'HOSTILE' WHEN {trending} THEN 'FAVORABLE' ELSE 'NEUTRAL' END AS state_name",
    )


def exposure(df: DataFrame) -> DataFrame:
    """Flat in hostile states, fully long otherwise; a missing state counts as neutral."""
    return df.selectExpr("*", f"IF(coalesce(lattice_state, {NEUTRAL}) = {HOSTILE}, 0D, 1D) AS exposure")


def component_signals(bars: DataFrame) -> DataFrame:
    """Trend signal against the 50-bar mean and half-size RSI(14) reversal signal."""
    df = with_raw_rsi(bars, 14, f"{R.mean('close', 50)} AS ma_50")
    return df.selectExpr(
        "*",
        "IF(close > ma_50, 1D, -1D) AS momentum_signal",
        "CASE WHEN rsi_14 < 30 THEN 0.5D WHEN rsi_14 > 70 THEN -0.5D ELSE 0D END AS reversal_signal",
    )


def decide(df: DataFrame, probabilities: list[str]) -> DataFrame:
    """Trade action from the state and the exposure held so far, and the mean distance from 0.5."""
    held = f"lag(IF(lattice_state = {HOSTILE}, 0, 1), 1, 0) {R.over()}"
    distance = " + ".join(f"abs({p} - 0.5D) * 2" for p in probabilities)
    return df.selectExpr("*", f"{held} AS current_exposure").selectExpr(
        "*",
        f"CASE WHEN lattice_state = {HOSTILE} THEN 'EXIT_TO_CASH' WHEN current_exposure = 0 THEN 'ENTER_LONG' "
        "ELSE 'HOLD' END AS action",
        f"({distance}) / {len(probabilities)} AS confidence",
    )


def vol_gate(bars: DataFrame, n: int = 20, q: float = 0.7) -> DataFrame:
    """Long while rolling volatility is below its own full-sample quantile (in-sample by design).

    Warm-up rows have no volatility and stay flat. A symbol's first bar has no return and is dropped.
    """
    df = bars.selectExpr("*", f"{R.change('close', 1)} AS ret").where("ret IS NOT NULL")
    df = df.selectExpr("*", f"{R.std('ret', n)} AS gate_vol")
    df = df.selectExpr("*", f"percentile(gate_vol, {q}) OVER (PARTITION BY symbol) AS gate_threshold")
    return df.selectExpr(
        "*",
        "IF(gate_vol < gate_threshold, 1, 0) AS position",
        "IF(gate_vol > gate_threshold, 'HOSTILE', 'NEUTRAL') AS regime",
    )


def position_size(df: DataFrame, base: int = 100) -> DataFrame:
    """Whole shares from confidence (full at 0.7) and state."""
    scale = "CASE state_name WHEN 'HOSTILE' THEN 0.5D WHEN 'FAVORABLE' THEN 1D ELSE 0.75D END"
    return df.selectExpr("*", f"CAST({base} * least(1D, confidence / 0.7D) * {scale} AS INT) AS position_size")


def info_label(bars: DataFrame, horizon: int = RESEARCH.horizon) -> DataFrame:
    """1 where the next ``horizon`` bars move in the direction of the last ``horizon`` bars."""
    past = R.change("close", horizon)
    future = f"{div(R.lead('close', horizon), 'close')} - 1"
    return bars.selectExpr("*", f"IF(signum({past}) = signum({future}), 1, 0) AS regime_info")


def orthogonality(labels: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlation of label columns per symbol; for 0/1 labels it equals the MCC."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]

    def rho(a: str, b: str) -> str:
        return f"{div(f'covar_samp({a}, {b})', f'stddev_samp({a}) * stddev_samp({b})')} AS {a}__{b}"

    wide = labels.groupBy("symbol").agg(*[F.expr(rho(a, b)) for a, b in pairs])
    strongest = ", ".join(f"abs({a}__{b})" for a, b in pairs)
    rows = ", ".join(f"struct('{a}' AS label_a, '{b}' AS label_b, {a}__{b} AS rho)" for a, b in pairs)
    return wide.selectExpr("symbol", f"array_max(array({strongest})) AS max_abs_rho", f"inline(array({rows}))")


def label_crosstab(labels: DataFrame, a: str, b: str, values: list[int]) -> DataFrame:
    """Counts and row shares of ``b`` within ``a`` per symbol."""
    counts = labels.groupBy("symbol", a).agg(*[F.expr(f"count_if({b} = {v}) AS n_{v}") for v in values])
    total = " + ".join(f"n_{v}" for v in values)
    return counts.selectExpr("*", *[f"{div(f'CAST(n_{v} AS DOUBLE)', total)} AS share_{v}" for v in values])
