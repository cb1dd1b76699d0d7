"""Option chains as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def normalize_chain(df: DataFrame) -> DataFrame:
    """Typed quotes; a missing volume or open interest is 0."""
    return df.selectExpr(
        "underlying", "CAST(as_of AS DATE) AS as_of", "CAST(expiration AS DATE) AS expiration", "CAST(strike AS DOUBLE) AS strike",
        "lower(option_type) AS option_type", "coalesce(CAST(bid AS DOUBLE), 0D) AS bid", "coalesce(CAST(ask AS DOUBLE), 0D) AS ask",
        "coalesce(CAST(last AS DOUBLE), 0D) AS last", "coalesce(CAST(volume AS BIGINT), 0) AS volume",
        "coalesce(CAST(open_interest AS BIGINT), 0) AS open_interest", "CAST(iv AS DOUBLE) AS iv",
        "CAST(underlying_price AS DOUBLE) AS underlying_price",
    )
