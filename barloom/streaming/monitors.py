"""Stream monitors. Each takes a streaming or a static frame; on a static one it is its own batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions.scan import trailing_count
from barloom.operators.telemetry import order_id, slippage

#: What tells signals apart. The order id is only a part of a digest.
SIGNAL_KEY = ["day", "symbol", "side", "signal_id"]


def dedupe_signals(signals: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per day, symbol, side and signal; a stream forgets them once the watermark has passed."""
    sided = order_id(signals.selectExpr("*", "IF(signal = 'EXIT_TO_CASH', 'sell', 'buy') AS side"))
    if sided.isStreaming:
        return sided.withWatermark("ts", delay).dropDuplicatesWithinWatermark(SIGNAL_KEY)
    return sided.dropDuplicates(SIGNAL_KEY)


def fill_monitor(fills: DataFrame, limit_bps: float = 50.0, delay: str = "1 hour") -> DataFrame:
    """Daily fill count, mean and worst slippage, and the breach flag."""
    df = slippage(fills)
    if df.isStreaming:
        df = df.withWatermark("fill_ts", delay)
    out = df.groupBy(F.window("fill_ts", "1 day").alias("w")).agg(
        F.expr("count(*) AS fills"), F.expr("avg(slippage_bps) AS avg_slippage_bps"),
        F.expr("greatest(max(slippage_bps), 0D) AS max_slippage_bps"), F.expr(f"max(slippage_bps) > {limit_bps} AS breach"),
    )
    return out.selectExpr("CAST(w.start AS DATE) AS day", "* EXCEPT (w)")


def rate_breach(requests: DataFrame, limit: int = 10, seconds: int = 60, key: str = "account_id") -> DataFrame:
    """Requests that come when more than ``limit`` were made in the trailing minute, itself included."""
    counted = trailing_count(requests, [key], "ts", seconds, "requests_in_span")
    return counted.where(f"requests_in_span > {limit}")


def rate_windows(requests: DataFrame, limit: int = 10, delay: str = "1 minute", key: str = "account_id") -> DataFrame:
    """Streaming form of the rate check: sliding one-minute windows every ten seconds with too many requests."""
    df = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    counts = df.groupBy(key, F.window("ts", "60 seconds", "10 seconds").alias("w")).agg(F.expr("count(*) AS requests"))
    return counts.where(f"requests > {limit}").selectExpr(key, "w.start AS window_start", "requests")


def signal_counts(signals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Signals per day and type, with their routing: holds are recorded, the rest become orders."""
    df = signals.withWatermark("ts", delay) if signals.isStreaming else signals
    out = df.groupBy(F.window("ts", "1 day").alias("w"), "signal").agg(F.expr("count(*) AS n"))
    return out.selectExpr("CAST(w.start AS DATE) AS day", "signal", "IF(signal = 'HOLD', 'recorded', 'order') AS route", "n")


def recon_stream(expected: DataFrame, actual: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each expected decision with the actual decisions of its symbol in the day that follows it.

    The day that follows touches two calendar days, so an expected row is keyed by both and the join is on
    symbol and day; the time bound lets a stream drop old state.
    """
    e = expected.selectExpr(
        "symbol", "ts AS expected_ts", "action AS expected_action", "price AS expected_price",
        "explode(array(to_date(ts), date_add(to_date(ts), 1))) AS _day",
    )
    a = actual.selectExpr(
        "symbol AS _symbol", "to_date(ts) AS _actual_day", "ts AS actual_ts", "action AS actual_action", "price AS actual_price"
    )
    if expected.isStreaming:
        e = e.withWatermark("expected_ts", delay)
    if actual.isStreaming:
        a = a.withWatermark("actual_ts", delay)
    near = "symbol = _symbol AND _day = _actual_day AND actual_ts >= expected_ts AND actual_ts < expected_ts + INTERVAL 1 DAY"
    return e.join(a, F.expr(near), "inner").selectExpr(
        "* EXCEPT (_symbol, _day, _actual_day)", "expected_action = actual_action AS is_aligned"
    )
