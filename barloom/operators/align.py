"""Alignment of series on ``(symbol, date)``: inner, left with fill, as-of, and walk-forward windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from barloom.plans.stage import staged

KEYS = ["symbol", "date"]


def align(frames: list[DataFrame], on: list[str] = KEYS) -> DataFrame:
    """Rows present in every frame."""
    return reduce(lambda a, b: a.join(b, on, "inner"), frames)


def align_left(df: DataFrame, other: DataFrame, fill: dict[str, object], on: list[str] = KEYS) -> DataFrame:
    """Left join with a fill value per column of ``other``."""
    joined = df.join(other.select(*on, *fill), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def asof_join(bars: DataFrame, index_bars: DataFrame, value: str = "close", out: str = "index_close", width: int = 32) -> DataFrame:
    """Latest benchmark value at or before each bar date; null before the first.

    The benchmark is cut into buckets of ``width`` days. A bucket's row holds its values by date and the last value before it, and a
    bar meets the row of its own bucket, so the bars are read once and only an equi-join deals them, if that side is too large to
    broadcast. Dates without a value are passed over; of several values of a date the largest counts. Runs the benchmark at once.
    """
    dated = index_bars.selectExpr("date", f"CAST({value} AS DOUBLE) AS _v").where("_v IS NOT NULL").groupBy("date").agg(F.expr("max(_v) AS _v"))
    dated = staged(dated.selectExpr("*", f"floor(unix_date(CAST(date AS DATE)) / {width}) AS _bucket"), "benchmark")
    low, high = dated.agg(F.min("_bucket"), F.max("_bucket")).first()
    if low is None:
        return bars.withColumn(out, F.lit(None).cast("double"))
    per_bucket = dated.groupBy("_bucket").agg(
        F.array_sort(F.collect_list(F.struct(F.col("date").alias("day"), F.col("_v").alias("v")))).alias("_days"))
    ends = per_bucket.selectExpr("_bucket", "element_at(_days, -1).v AS _last")
    # one bucket more stands for all later dates
    buckets = bars.sparkSession.range(low, high + 2).selectExpr("id AS _bucket")
    side = carry_forward(buckets, ends, low, high + 1).join(per_bucket, "_bucket", "left").withColumnRenamed("_bucket", "_side")
    own = F.expr(f"least(floor(unix_date(CAST(date AS DATE)) / {width}), {high + 1}L)")
    joined = bars.withColumn("_bucket", own).join(side, F.col("_bucket") == F.col("_side"), "left")
    found = F.expr("coalesce(try_element_at(filter(_days, x -> x.day <= date), -1).v, _carry)")
    return joined.withColumn(out, found).drop("_bucket", "_side", "_days", "_carry")


def carry_forward(buckets: DataFrame, ends: DataFrame, low: int, high: int) -> DataFrame:
    """(_bucket, _carry): the ``_last`` of the latest row of ``ends`` before each of ``buckets``, all from ``low`` to ``high``.

    The buckets before number k fill one block of 2^l buckets for each binary digit of k, so every end goes to the blocks that hold
    it, one a level, and every bucket to its own blocks. Nothing is ordered as a whole.
    """
    levels = (high - low).bit_length()
    if not levels:
        return buckets.selectExpr("_bucket", "CAST(NULL AS DOUBLE) AS _carry")
    each = f"explode(sequence(0, {levels - 1})) AS _level"
    blocks = ends.selectExpr("*", each).groupBy("_level", F.expr(f"shiftright(_bucket - {low}L, _level)").alias("_block")).agg(
        F.expr("max(struct(_bucket AS at, _last AS v)) AS _end"))
    needed = buckets.selectExpr("*", each).where(f"shiftright(_bucket - {low}L, _level) % 2 = 1").selectExpr(
        "_bucket", "_level", f"shiftright(_bucket - {low}L, _level) - 1 AS _block")
    latest = needed.join(blocks, ["_level", "_block"]).groupBy("_bucket").agg(F.expr("max(_end).v AS _carry"))
    return buckets.join(latest, "_bucket", "left")


def assign_windows(df: DataFrame, windows: DataFrame, test_days: int, train_days: int) -> DataFrame:
    """Rows with the walk-forward windows they fall in and their role, without a range join.

    Windows start ``test_days`` apart, so the window numbers of a row follow from its day offset:
    it tests in one window and trains in the following ``train_days / test_days``.
    """
    starts = windows.select("symbol", "first_date").distinct()
    lo = f"greatest(floor((datediff(date, first_date) - {train_days}) / {test_days}) + 1, 1)"
    hi = f"floor(datediff(date, first_date) / {test_days}) + 1"
    numbered = df.join(starts, "symbol").where(f"{hi} >= {lo}").selectExpr(
        "*", f"explode(sequence(CAST({lo} AS INT), CAST({hi} AS INT))) AS window_id"
    )
    tagged = numbered.selectExpr(
        "* EXCEPT (first_date)",
        f"IF(date < date_add(first_date, {train_days} + (window_id - 1) * {test_days}), 'train', 'test') AS role",
    )
    return tagged.join(windows.select("symbol", "window_id"), ["symbol", "window_id"], "left_semi")


def union_features(frames: list[DataFrame], fill_exclude: list[str] = KEYS) -> DataFrame:
    """Union of per-market feature frames; columns a frame does not have become 0."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.na.fill(0.0, [c for c in out.columns if c not in fill_exclude])
