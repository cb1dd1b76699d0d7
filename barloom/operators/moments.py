"""Walk-forward fits from mergeable moment sums: rows are summed once per time bucket, windows are sums of buckets.

A row trains in ``train_days / test_days`` windows. Copying it into each multiplies the data by that number; instead the rows of
a symbol are summed into buckets of as many days as both spans are multiples of, and a window adds up its buckets by a range
frame. Several targets, such as shifted or shuffled labels, share the pass: each only adds its own products with the features, and each
is fitted from its own sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH

#: Share of the sum of squares under which a variance is rounding of a constant.
_FLAT = 1e-12


def bucket_days(train_days: int, test_days: int) -> int:
    return math.gcd(train_days, test_days)


def with_bucket(df: DataFrame, starts: DataFrame, days: int) -> DataFrame:
    """``df`` with the number of its bucket; ``starts`` has ``first_date`` per symbol."""
    return df.join(starts.select("symbol", "first_date"), "symbol").selectExpr("* EXCEPT (first_date)", f"datediff(date, first_date) DIV {days} AS bucket")


def framed_sums(buckets: DataFrame, windows: DataFrame, sums: list[str], span: int, step: int) -> DataFrame:
    """``sums`` of every window over its ``span`` training buckets. ``windows``: symbol, window_id; window w starts at bucket (w - 1) * step.

    Each window adds an empty row at its test start, so that its frame exists whether or not that bucket has rows.
    """
    marks = windows.selectExpr("symbol", f"CAST((window_id - 1) * {step} + {span} AS BIGINT) AS bucket", "window_id")
    rows = buckets.selectExpr("symbol", "CAST(bucket AS BIGINT) AS bucket", "CAST(NULL AS BIGINT) AS window_id", *sums).unionByName(
        marks.selectExpr("symbol", "bucket", "CAST(window_id AS BIGINT) AS window_id"), allowMissingColumns=True)
    over = f"OVER (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING)"
    return rows.selectExpr("symbol", "window_id", *[f"coalesce(sum({s}) {over}, 0) AS {s}" for s in sums]).where("window_id IS NOT NULL")


def moment_sums(df: DataFrame, features: list[str], targets: list[str], by: list[str], centres: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """Sums from which the correlation of every feature with every target follows, and their names.

    Rows with a null feature or target are left out. ``centres`` are subtracted first, which changes no correlation but
    keeps digits for features that lie far from zero.
    """
    x = {f: f"({f} - {float((centres or {}).get(f, 0.0))!r}D)" for f in features}
    terms = {"_n": "1D"} | {f"_s_{f}": e for f, e in x.items()} | {f"_ss_{f}": f"{e} * {e}" for f, e in x.items()}
    for t in targets:
        terms |= {f"_t_{t}": f"CAST({t} AS DOUBLE)", f"_tt_{t}": f"CAST({t} * {t} AS DOUBLE)"} | {f"_p_{t}_{f}": f"{e} * {t}" for f, e in x.items()}
    full = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*features, *targets]))
    return full.groupBy(*by).agg(*[F.expr(f"sum({e}) AS {name}") for name, e in terms.items()]), list(terms)


def correlation(feature: str, target: str) -> str:
    """Pearson correlation from :func:`moment_sums`; null where either side doesn't vary."""
    sx, sxx, sy, syy = f"_s_{feature}", f"_ss_{feature}", f"_t_{target}", f"_tt_{target}"
    vx, vy = f"(_n * {sxx} - {sx} * {sx})", f"(_n * {syy} - {sy} * {sy})"
    return (f"CASE WHEN {vx} > {_FLAT!r}D * _n * {sxx} AND {vy} > {_FLAT!r}D * _n * {syy} "
            f"THEN (_n * _p_{target}_{feature} - {sx} * {sy}) / sqrt({vx} * {vy}) END")


def window_moments(
    df: DataFrame, windows: DataFrame, features: list[str], targets: list[str], train_days: int = RESEARCH.train_days,
    test_days: int = RESEARCH.test_days, centres: dict[str, float] | None = None,
) -> DataFrame:
    """:func:`moment_sums` of every window's training rows. ``df`` has ``bucket``; ``windows``: symbol, window_id."""
    days = bucket_days(train_days, test_days)
    buckets, sums = moment_sums(df, features, targets, ["symbol", "bucket"], centres)
    return framed_sums(buckets, windows, sums, train_days // days, test_days // days)


def test_rows(df: DataFrame, windows: DataFrame, train_days: int = RESEARCH.train_days, test_days: int = RESEARCH.test_days) -> DataFrame:
    """Rows with the one window each is tested in. ``df`` has ``bucket``."""
    days = bucket_days(train_days, test_days)
    span, step = train_days // days, test_days // days
    own = df.where(f"bucket >= {span}").selectExpr("* EXCEPT (bucket)", f"CAST((bucket - {span}) DIV {step} + 1 AS BIGINT) AS window_id")
    return own.join(windows.selectExpr("symbol", "CAST(window_id AS BIGINT) AS window_id"), ["symbol", "window_id"], "left_semi")
