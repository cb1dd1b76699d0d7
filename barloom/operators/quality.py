"""Data quality checks and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.functions.text import div, safe_div

NOT_FEATURES = (
    "symbol", "date", "open", "high", "low", "close", "volume", "next_day_return", "target_return_1d", "target_direction",
)


def validate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per required column in one pass; raises when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    counts = df.agg(F.expr("count(*) AS n_rows"), *[F.expr(f"count_if({c} IS NULL) AS {c}") for c in columns])
    rows = ", ".join(f"struct('{c}' AS column_name, {c} AS null_count)" for c in columns)
    return counts.selectExpr("n_rows", f"inline(array({rows}))")


def with_ratio(df: DataFrame, a: str, b: str, out: str, fill: float = 0.0) -> DataFrame:
    """Division that gives ``fill`` for a zero or missing denominator."""
    return df.selectExpr("*", f"{safe_div(a, b, fill)} AS {out}")


def as_of(df: DataFrame, ts: str, column: str = "date") -> DataFrame:
    """Point-in-time view: rows known at ``ts``."""
    return df.where(f"{column} <= DATE '{ts}'")


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Everything that is not a key, a price or a target."""
    return [c for c in df.columns if c not in exclude]


def finalize_features(df: DataFrame, target: str = "next_day_return", legacy_fill: bool = False) -> DataFrame:
    """Drop rows without a target, then fill features with 0; ``legacy_fill`` keeps and zero-fills those rows."""
    columns = feature_columns(df)
    if legacy_fill:
        return df.na.fill(0.0, [*columns, target])
    return df.where(f"{target} IS NOT NULL").na.fill(0.0, columns)


def drop_neutral(df: DataFrame, direction: str = "target_direction") -> DataFrame:
    return df.where(f"{direction} <> 0")


def flag_unadjusted_splits(bars: DataFrame, limit: float = -0.5) -> DataFrame:
    """Open-to-open moves below ``limit``: the mark of a split that was not adjusted for."""
    change = div(f"open - {R.lag('open')}", R.lag("open"))
    return bars.selectExpr("*", f"{change} AS open_return").where(f"open_return < {limit}")


def feature_importance(df: DataFrame, columns: list[str], target: str = "next_day_return") -> DataFrame:
    """Absolute correlation of every feature with the target, as ``(feature, importance)`` rows."""

    def rho(c: str) -> str:
        x, y = f"IF({target} IS NULL, NULL, {c})", f"IF({c} IS NULL, NULL, {target})"
        return f"abs({div(f'covar_samp({x}, {y})', f'stddev_samp({x}) * stddev_samp({y})')}) AS {c}"

    wide = df.agg(*[F.expr(rho(c)) for c in columns])
    rows = ", ".join(f"struct('{c}' AS feature, {c} AS importance)" for c in columns)
    return wide.selectExpr(f"inline(array({rows}))")


# Fixed value: name parts that mark features built from the decision day itself.
SUSPECT_PATTERN = "close|high|low|return_1d|momentum_1"


def leak_suspects(importances: DataFrame, pattern: str = SUSPECT_PATTERN) -> DataFrame:
    """Features whose name suggests same-day information, strongest first."""
    return importances.where(F.expr(f"lower(feature) RLIKE '{pattern}'")).orderBy(F.desc("importance"), "feature")
