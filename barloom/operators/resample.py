"""Resampling tests: block bootstrap, regime-preserving shuffle, and their null distributions.

The unit of work is one resample of one symbol, held as arrays of at most a few thousand values (one per
trading day). Symbols are first split into chunks of resamples and shuffled by ``(symbol, chunk)``; the
resamples themselves are made and measured after that shuffle, so only one short array per chunk travels
and no row per resampled day is ever shuffled or sorted. All draws are keyed, so a lost task repeats itself.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.config import RESEARCH, TRADING_DAYS
from barloom.functions.text import keyed_draw


def series_arrays(df: DataFrame, columns: list[str], by: str = "symbol") -> DataFrame:
    """One row per symbol with each column as an array in date order, and the length ``n``.

    ``(symbol, date)`` is unique, so an array holds one value per trading day.
    """
    packed = df.groupBy(by).agg(F.expr(f"array_sort(collect_list(struct(date, {', '.join(columns)}))) AS _s"))
    return packed.selectExpr(by, "size(_s) AS n", *[f"_s.{c} AS {c}" for c in columns])


def bind(df: DataFrame, *columns: str) -> DataFrame:
    """Add columns that are computed once per row.

    A plain projection may be merged into later ones, and a filter pushed below it, which would repeat an
    array expression for every element that refers to it. A generator of one row is a fence against both.
    """
    return df.selectExpr("*", f"inline(array(struct({', '.join(columns)})))")


def spread(arrays: DataFrame, n_paths: int, by: str = "symbol", chunk: int = 50, first: int = 0) -> DataFrame:
    """One row per symbol and ``path_id``, spread over the cluster in chunks."""
    chunks = math.ceil(n_paths / chunk)
    partitions = arrays.sparkSession.sparkContext.defaultParallelism
    df = arrays.selectExpr("*", f"explode(sequence(0, {chunks - 1})) AS _chunk").repartition(partitions, by, "_chunk")
    paths = f"explode(sequence({first} + _chunk * {chunk}, {first} + least((_chunk + 1) * {chunk}, {n_paths}) - 1))"
    return df.selectExpr("* EXCEPT (_chunk)", f"{paths} AS path_id")


_CURVE = StructType([StructField(c, DoubleType()) for c in ("max_dd", "final_return", "crash_exposure")])


def curve_stats(threshold: float):
    """Column function over arrays of returns and positions: deepest fall from the running peak of the
    compounded strategy (the start is no peak), its total return, and the mean position on crash days.

    A compounding curve is a fold with three accumulators; as a built-in array fold each step is
    interpreted and boxed, some twenty times slower than one Arrow batch through numpy.
    """

    @F.pandas_udf(_CURVE)
    def stats(returns: pd.Series, positions: pd.Series) -> pd.DataFrame:
        out = np.empty((len(returns), 3))
        for k, (r, p) in enumerate(zip(returns, positions)):
            curve = np.cumprod(1.0 + r * p)
            crash = r < threshold
            out[k] = (curve / np.maximum.accumulate(curve) - 1.0).min(), curve[-1] - 1.0, p[crash].mean() if crash.any() else 0.0
        return pd.DataFrame(out, columns=_CURVE.names)

    return stats


def block_bootstrap(arrays: DataFrame, n_perm: int, block: int = 20, seed: int = RESEARCH.seed, value: str = "ret", chunk: int = 50) -> DataFrame:
    """Resampled returns from random blocks; block starts are uniform in [0, max(1, n - block))."""
    start = f"CAST({keyed_draw(f"'{seed}'", 'symbol', 'path_id', 'b')} % greatest(n - {block}, 1) AS INT) + 1"
    blocks = f"transform(sequence(0, CAST(ceil(n / {block}D) AS INT) - 1), b -> slice({value}, {start}, {block}))"
    return spread(arrays, n_perm, chunk=chunk).selectExpr("*", f"slice(flatten({blocks}), 1, n) AS perm_ret")


def regime_shuffle(arrays: DataFrame, n_perm: int, seed: int = RESEARCH.seed, value: str = "ret", regime: str | None = "regime", chunk: int = 50) -> DataFrame:
    """Values dealt in keyed random order within each regime, or over the whole series when ``regime`` is None.

    Sorting by (regime, index) and by (regime, draw) lines up each regime's days with its shuffled values.
    """
    label = f"{regime}[i]" if regime else "0"
    natural = arrays.selectExpr("*", f"array_sort(transform(sequence(0, n - 1), i -> struct({label} AS g, i AS i))) AS _natural")
    draw = keyed_draw(f"'{seed}'", "symbol", "path_id", "i")
    dealt = f"array_sort(transform(sequence(0, n - 1), i -> struct({label} AS g, {draw} AS d, i AS i)))"
    df = spread(natural, n_perm, chunk=chunk).selectExpr(
        "* EXCEPT (_natural)", f"array_sort(zip_with(_natural, {dealt}, (a, b) -> struct(a.i AS i, {value}[b.i] AS v))) AS _z"
    )
    return df.selectExpr("* EXCEPT (_z)", "_z.v AS perm_ret")


def resample_metrics(resampled: DataFrame, threshold: float = -0.02) -> DataFrame:
    """Max drawdown and crash exposure of the fixed positions on every resample."""
    df = resampled.select("symbol", "path_id", curve_stats(threshold)("perm_ret", "position").alias("_c"))
    return df.selectExpr("symbol", "path_id", "_c.max_dd", "_c.crash_exposure")


def real_metrics(arrays: DataFrame, threshold: float = -0.02) -> DataFrame:
    df = arrays.select("symbol", curve_stats(threshold)("ret", "position").alias("_c"))
    return df.selectExpr("symbol", "_c.max_dd AS real_max_dd", "_c.crash_exposure AS real_crash_exposure")


def permutation_summary(arrays: DataFrame, nulls: DataFrame, pass_at: float = 0.95) -> DataFrame:
    """Share of resamples with a worse drawdown and with more crash exposure, and the null distributions.

    Compared values are rounded to nine places: a resample that equals the real series is not worse by noise.
    """
    df = nulls.join(real_metrics(arrays), "symbol").groupBy("symbol").agg(
        F.expr("count(*) AS n_permutations"), F.expr("max(real_max_dd) * 100 AS real_max_dd"),
        F.expr("max(real_crash_exposure) * 100 AS real_crash_exposure"),
        F.expr("avg(IF(round(max_dd, 9) < round(real_max_dd, 9), 1D, 0D)) AS _dd"), F.expr("avg(IF(round(crash_exposure, 9) > round(real_crash_exposure, 9), 1D, 0D)) AS _crash"),
        *[F.expr(e) for c in ("max_dd", "crash_exposure") for e in (
            f"avg({c}) * 100 AS null_{c}_mean", f"stddev_pop({c}) * 100 AS null_{c}_std",
            f"percentile({c}, 0.05) * 100 AS null_{c}_p05", f"percentile({c}, 0.95) * 100 AS null_{c}_p95")],
    )
    return df.selectExpr(
        "* EXCEPT (_dd, _crash)", "_dd * 100 AS dd_percentile", "_crash * 100 AS crash_percentile",
        f"_dd >= {pass_at} AS passes_dd", f"_crash >= {pass_at} AS passes_crash", f"_dd >= {pass_at} AND _crash >= {pass_at} AS overall_pass",
    )


_STATE = StructType([StructField(c, DoubleType()) for c in ("total_return", "sharpe")])


def state_stats(cost_bps: float):
    """Column function over arrays of exposures and next-day returns: total return and Sharpe ratio (sample deviation) net of
    costs on changes of exposure, the first one included. Days without a return are left out. One Arrow batch through numpy."""

    @F.pandas_udf(_STATE)
    def stats(exposures: pd.Series, returns: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(exposures), 2))
        for k, (held, r) in enumerate(zip(exposures, returns)):
            held = np.asarray(held, float)
            net = held * np.asarray(r, float) - np.abs(np.diff(held, prepend=0.0)) * (cost_bps / 10000)
            net = net[~np.isnan(net)]
            deviation = net.std(ddof=1) if len(net) > 1 else 0.0
            out[k] = np.prod(1.0 + net) - 1.0, net.mean() / deviation * math.sqrt(TRADING_DAYS) if deviation > 0 else 0.0
        return pd.DataFrame(out, columns=_STATE.names)

    return stats


def state_shuffle_test(df: DataFrame, n_perm: int = 50, cost_bps: float = RESEARCH.cost_bps, seed: int = RESEARCH.seed) -> DataFrame:
    """Does the order of the states matter? Exposures are dealt to other days and back-tested again.

    Needs ``exposure`` and ``next_open_return``. The p-value is the share of shuffles with a Sharpe ratio at
    least as high as the real one.
    """
    arrays = series_arrays(df, ["exposure", "next_open_return"])
    stats = state_stats(cost_bps)
    real = arrays.select("symbol", stats("exposure", "next_open_return").alias("_c")).selectExpr("symbol", "_c.total_return AS real_total_return", "_c.sharpe AS real_sharpe")
    shuffled = regime_shuffle(arrays, n_perm, seed, "exposure", None)
    nulls = shuffled.select("symbol", "path_id", stats("perm_ret", "next_open_return").alias("_c")).selectExpr("symbol", "path_id", "_c.total_return", "_c.sharpe")
    out = nulls.join(real, "symbol").groupBy("symbol").agg(
        F.expr("max(real_total_return) AS real_total_return"), F.expr("max(real_sharpe) AS real_sharpe"),
        F.expr("avg(IF(round(sharpe, 9) >= round(real_sharpe, 9), 1D, 0D)) AS p_value"), F.expr("avg(total_return) AS null_mean_return"),
        F.expr("percentile(total_return, 0.95) AS null_p95_return"),
    )
    return out.selectExpr("*", "p_value < 0.05D AS significant", "real_total_return > null_p95_return AS beats_p95")
