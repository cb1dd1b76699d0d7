"""Benchmark-relative features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.functions import rolling as R
from barloom.operators.align import asof_join


def market_features(bars_feat: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Benchmark returns, relative strength and rolling beta; needs ``return_1d``."""
    periods = (1, 3, 5, 10, 20)
    df = asof_join(bars_feat, index_bars)
    df = df.selectExpr("*", *[f"{R.change('index_close', n)} AS _index_return_{n}" for n in periods])
    cols = [f"_index_return_{n} AS index_return_{n}d" for n in (1, 3, 5, 10)]
    cols += [f"{R.change('close', n)} - _index_return_{n} AS relative_strength_{n}d" for n in (5, 10, 20)]
    cols += [f"{R.slope_ratio('return_1d', '_index_return_1', n)} AS beta_approx_{n}" for n in (20, 60)]
    return df.selectExpr("*", *cols).drop("index_close", *[f"_index_return_{n}" for n in periods])
