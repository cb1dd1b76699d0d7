"""Margin requirements by position type and per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.scan import running_sum


def margin(positions: DataFrame) -> DataFrame:
    """Initial and maintenance margin and buying power. The short-call add-on is the in-the-money amount, as published."""
    df = positions.selectExpr("*", "underlying_price * 100 * contracts AS _n", "premium * 100 * contracts AS _p")
    width = "coalesce(spread_width, 5D) * 100 * contracts"
    call_add = "greatest(0D, underlying_price - strike) * 100 * contracts"
    put_off = "greatest(0D, strike - underlying_price) * 100 * contracts"
    short_call = f"(_n * 0.2D + _p + {call_add})"
    short_put = f"greatest(_n * 0.1D, _n * 0.2D + _p - {put_off})"
    spreads = "position_type IN ('iron_condor', 'put_spread', 'call_spread')"
    longs = "position_type IN ('long_call', 'long_put')"
    return df.selectExpr(
        "* EXCEPT (_n, _p)",
        f"CASE WHEN {longs} THEN _p WHEN position_type = 'covered_call' THEN _n * 0.5D WHEN position_type = 'protective_put' THEN _n * 0.5D + _p "
        f"WHEN position_type = 'short_call' THEN {short_call} WHEN position_type = 'short_put' THEN {short_put} WHEN {spreads} THEN {width} - _p ELSE _n END AS initial_margin",
        f"CASE WHEN {longs} THEN 0D WHEN position_type = 'short_call' THEN {short_call} * 0.8D WHEN position_type = 'short_put' THEN {short_put} * 0.8D "
        f"WHEN {spreads} THEN {width} ELSE _n * 0.25D END AS maintenance_margin",
        f"CASE WHEN {longs} THEN _p WHEN position_type = 'covered_call' THEN _n * 0.5D - _p WHEN position_type = 'protective_put' THEN _n * 0.5D + _p "
        f"WHEN position_type = 'short_call' THEN {short_call} WHEN position_type = 'short_put' THEN {short_put} WHEN {spreads} THEN {width} ELSE _n END AS buying_power_impact",
    )


def account_margin(margined: DataFrame, equity: float = 100_000.0, max_ratio: float = 0.6, min_excess: float = 5_000.0, shock: float = 0.0) -> DataFrame:
    """Account roll-up, maintenance call, and the ratio after the underlyings move by ``shock``."""
    e = f"{equity!r}D"
    df = margined.groupBy("account_id").agg(
        F.expr("count(*) AS positions"), F.expr("sum(initial_margin) AS margin_used"), F.expr("sum(maintenance_margin) AS maintenance_required")
    )
    return df.selectExpr(
        "*", f"{e} * {max_ratio!r}D - margin_used AS margin_available", f"{e} - margin_used AS buying_power",
        f"{e} - margin_used - {min_excess!r}D AS maintenance_excess", f"margin_used / {e} AS margin_ratio",
        f"greatest(0D, maintenance_required - {e}) AS margin_call", f"margin_used * {1 + shock!r}D / {e} AS shocked_ratio",
    )


def admission(margined: DataFrame, order: list[str], bucket: str, equity: float = 100_000.0, max_ratio: float = 0.6, min_excess: float = 5_000.0) -> DataFrame:
    """Positions in the order they are opened with the margin used so far and whether the limits still hold.

    The running sum is a bucketed scan, so one very large account is spread over many tasks.
    """
    df = running_sum(margined, ["account_id"], bucket, order, "initial_margin", "margin_so_far")
    e = f"{equity!r}D"
    return df.selectExpr("*", f"margin_so_far / {e} <= {max_ratio!r}D AND {e} - margin_so_far >= {min_excess!r}D AS allowed")
