"""News feeds: two wire formats to one schema, and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Field names of the two public feed formats.
EPOCH_FEED = "array<struct<datetime:bigint,headline:string,summary:string,source:string,url:string>>"
ISO_FEED = (
    "array<struct<publishedAt:string,title:string,description:string,source:struct<name:string>,url:string>>"
)


def normalize_news(df: DataFrame, feed: str, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Rows ``(symbol, ts, headline, summary, source, url)`` from a column of raw JSON arrays.

    ``feed`` is 'epoch' (seconds since 1970, flat fields) or 'iso' (ISO time, nested source).
    """
    schema = EPOCH_FEED if feed == "epoch" else ISO_FEED
    items = df.selectExpr(f"{symbol} AS symbol", f"inline(from_json({payload}, '{schema}'))")
    if feed == "epoch":
        return items.selectExpr(
            "symbol", "timestamp_seconds(coalesce(datetime, 0)) AS ts", "coalesce(headline, '') AS headline",
            "coalesce(summary, '') AS summary", "coalesce(source, '') AS source", "coalesce(url, '') AS url",
        )
    return items.selectExpr(
        "symbol", "try_to_timestamp(publishedAt) AS ts", "coalesce(title, '') AS headline",
        "coalesce(description, '') AS summary", "coalesce(source.name, '') AS source", "coalesce(url, '') AS url",
    )


def combine_news(primary: DataFrame, secondary: DataFrame, min_primary: int | None = None) -> DataFrame:
    """Both feeds. With ``min_primary`` the secondary feed only counts for symbols with fewer primary articles.

    Repeats of a headline at the same time keep the primary copy; among equals the smallest source wins.
    The reduction is an aggregate, so any number of copies collapses before the shuffle.
    """
    extra = secondary
    if min_primary is not None:
        full = primary.groupBy("symbol").agg(F.expr("count(*) AS n")).where(f"n >= {min_primary}").select("symbol")
        extra = secondary.join(full, "symbol", "left_anti")
    both = primary.selectExpr("*", "1 AS _priority").unionByName(
        extra.selectExpr("*", "2 AS _priority"), allowMissingColumns=True
    )
    rest = [c for c in both.columns if c not in ("symbol", "headline", "ts", "_priority")]
    fields = ", ".join(["_priority", *rest])
    kept = both.groupBy("symbol", "headline", "ts").agg(F.expr(f"min(struct({fields})) AS _row"))
    return kept.selectExpr("symbol", "headline", "ts", *[f"_row.{c} AS {c}" for c in rest])
