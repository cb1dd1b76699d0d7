"""Execution telemetry: slippage, order ids, size checks, parked cash, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.text import div
from barloom.operators.persistence import regime_runs

# Upper bounds of the telemetry histograms and yearly yields of the parking vehicles.
FILL_LATENCY_EDGES = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)
SLIPPAGE_EDGES = (0.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0)
VEHICLE_APY = {"money_market": 0.05, "tbills": 0.045, "cash": 0.0, "spaxx": 0.049}


def slippage(fills: DataFrame) -> DataFrame:
    """Signed slippage in basis points (positive is worse for both sides), notional and fill delay."""
    raw = f"coalesce({div('(actual_fill_price - expected_price)', 'expected_price')} * 10000, 0D)"
    return fills.selectExpr(
        "*",
        f"IF(expected_price > 0, IF(side = 'sell', -1, 1) * {raw}, 0D) AS slippage_bps",
        "actual_fill_price * qty AS notional",
        "CAST(unix_micros(fill_ts) - unix_micros(submit_ts) AS DOUBLE) / 1000 AS time_delay_ms",
    )


_STATS = (
    "avg(slippage_bps) AS mean_bps", "stddev_pop(slippage_bps) AS std_bps", "min(slippage_bps) AS min_bps",
    "max(slippage_bps) AS max_bps", "count(*) AS fills", "sum(notional) AS total_notional",
    "avg(IF(partial_fill, 1D, 0D)) AS partial_fill_rate",
)


def slippage_stats(slipped: DataFrame) -> DataFrame:
    """Statistics per symbol and, with symbol 'ALL', over everything, from one rollup."""
    out = slipped.rollup("symbol").agg(*[F.expr(s) for s in _STATS], F.expr("grouping(symbol) AS _all"))
    return out.selectExpr("IF(_all = 1, 'ALL', symbol) AS symbol", "* EXCEPT (symbol, _all)")


def slippage_bounds(stats: DataFrame, mean: float = 5.0, std: float = 5.0, tolerance: float = 1.0, min_fills: int = 5) -> DataFrame:
    """Whether the mean lies within tolerance: 'within', 'outside', or 'too_few' fills to tell (``within_bounds`` is null then)."""
    lo, hi = mean - tolerance * std, mean + tolerance * std
    checked = stats.selectExpr("symbol", "fills", "mean_bps", f"IF(fills < {min_fills}, NULL, mean_bps BETWEEN {lo!r}D AND {hi!r}D) AS within_bounds")
    return checked.selectExpr("*", "CASE WHEN within_bounds THEN 'within' WHEN NOT within_bounds THEN 'outside' ELSE 'too_few' END AS bounds_state")


def daily_slippage(slipped: DataFrame, limit_bps: float = 50.0) -> DataFrame:
    """Fills, mean and worst slippage per day with the breach flag; a day's worst is never below 0."""
    return slipped.groupBy(F.expr("to_date(fill_ts)").alias("day")).agg(
        F.expr("count(*) AS fills"), F.expr("avg(slippage_bps) AS avg_slippage_bps"),
        F.expr("greatest(max(slippage_bps), 0D) AS max_slippage_bps"),
        F.expr(f"max(slippage_bps) > {limit_bps} AS breach"),
    )


def order_id(df: DataFrame, day: str = "day", symbol: str = "symbol", side: str = "side", signal: str = "signal_id") -> DataFrame:
    """Deterministic client order id: the same signal on the same day gives the same id.

    Its last part is 32 bits of a digest, so it is for display; rows are told apart by day, symbol, side and signal.
    """
    date = f"date_format({day}, 'yyyyMMdd')"
    body = f"concat_ws('_', {date}, {symbol}, {side})"
    return df.selectExpr("*", f"concat({body}, '_', substr(md5(concat({body}, '_', {signal})), 1, 8)) AS client_order_id")


def config_hash(df: DataFrame, columns: list[str], out: str = "config_hash") -> DataFrame:
    """The md5 of the configuration columns."""
    return df.selectExpr("*", f"md5(concat_ws('|', {', '.join(columns)})) AS {out}")


def adv_check(orders: DataFrame, adv: DataFrame, max_pct: float = 0.01) -> DataFrame:
    """Order size against average daily volume; an unknown volume passes."""
    df = orders.join(adv, "symbol", "left").selectExpr("* EXCEPT (adv)", "coalesce(adv, 0D) AS adv")
    return df.selectExpr(
        "*", "IF(adv <= 0, NULL, qty / adv) AS pct_of_adv", f"adv <= 0 OR qty / adv <= {max_pct} AS allowed"
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Decision counts by signal and by source from one pass."""
    out = audit.groupingSets([["signal"], ["signal_source"]], "signal", "signal_source").agg(
        F.expr("count(*) AS n"), F.expr("grouping(signal) AS _g")
    )
    return out.selectExpr("IF(_g = 0, 'signal', 'source') AS dimension", "IF(_g = 0, signal, signal_source) AS value", "n")


def parking_yield(positions: DataFrame) -> DataFrame:
    """Simple interest of parked cash by vehicle rate and days parked."""
    rate = "CASE vehicle " + " ".join(f"WHEN '{v}' THEN {r!r}D" for v, r in VEHICLE_APY.items()) + " ELSE 0D END"
    df = positions.selectExpr("*", f"{rate} AS apy", "datediff(as_of, entry_date) AS days_parked")
    df = df.selectExpr("*", "amount * apy / 365 * days_parked AS accrued_yield")
    return df.selectExpr("*", "amount + accrued_yield AS current_value")


def parked_spells(strategy: DataFrame, vehicle: str, amount: float) -> DataFrame:
    """Parking positions from the flat spells of a strategy."""
    runs = regime_runs(strategy, "position").where("position = 0")
    return runs.selectExpr(
        "symbol", "run_id AS position_id", f"{vehicle} AS vehicle", f"{amount!r}D AS amount", "start_date AS entry_date", "end_date AS as_of"
    )


def parking_totals(parked: DataFrame) -> DataFrame:
    return parked.groupBy("vehicle").agg(
        F.expr("count(*) AS positions"), F.expr("sum(amount) AS principal"), F.expr("sum(accrued_yield) AS accrued_yield"),
        F.expr("sum(current_value) AS current_value"),
    )


def bucket_counts(df: DataFrame, value: str, edges: tuple[float, ...], by: list[str]) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, and all rows under the bound infinity.

    One conditional count per bound keeps the input un-multiplied and lets every task pre-aggregate.
    """
    aggs = [F.expr(f"count_if({value} <= {float(e)!r}D) AS _b{i}") for i, e in enumerate(edges)]
    wide = df.groupBy(*by).agg(*aggs, F.expr(f"count({value}) AS _all"))
    rows = [f"struct({float(e)!r}D AS le, _b{i} AS n)" for i, e in enumerate(edges)]
    rows.append("struct(DOUBLE('Infinity') AS le, _all AS n)")
    return wide.selectExpr(*by, f"inline(array({', '.join(rows)}))")


def orders_per_day(orders: DataFrame, ts: str = "timestamp") -> DataFrame:
    return orders.groupBy(F.expr(f"to_date({ts})").alias("day"), "order_status").agg(F.expr("count(*) AS n"))
