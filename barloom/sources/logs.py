"""Trade, PnL, fill and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FILL_SCHEMA = (
    "timestamp timestamp, order_id string, symbol string, side string, expected_price double, "
    "actual_fill_price double, slippage_bps double, qty double, notional double, time_delay_ms double, partial_fill boolean"
)
TRADE_SCHEMA = (
    "timestamp timestamp, symbol string, action string, signal_source string, expected_price double, order_id string, "
    "order_status string, filled_price double, filled_qty double, slippage_bps double, notes string"
)
AUDIT_SCHEMA = (
    "timestamp timestamp, decision_id string, vol_prob double, trend_prob double, liq_prob double, lattice_state string, "
    "regime_confidence double, signal string, signal_source string, order_type string, order_qty double, "
    "order_notional double, order_id string, order_status string, fill_price double, slippage_bps double, "
    "model_version string, config_hash string, notes string"
)


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A log as typed rows; JSON logs are arrays that span lines."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("quote", '"').option("escape", '"')
    if fmt == "json":
        reader = reader.option("multiLine", "true")
    return reader.load(path)


def between(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; the bounds reach a Parquet scan."""
    return df.where(f"{ts} >= TIMESTAMP '{start}' AND {ts} <= TIMESTAMP '{end}'")


def audit_recent(df: DataFrame, n: int = 20, ts: str = "timestamp", tie: str = "decision_id") -> DataFrame:
    """Newest ``n`` decisions; each task keeps its own top ``n``."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def audit_by_id(df: DataFrame, decision_id: str) -> DataFrame:
    return df.where(F.col("decision_id") == decision_id)
