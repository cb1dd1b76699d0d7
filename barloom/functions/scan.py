"""Ordered scans over groups that may be too large for one task.

A group's rows are cut into buckets of its own order (an hour, a day, a range of ids). Each bucket is
scanned on its own, the buckets' totals are scanned next, a far smaller input, and every row then adds
what came before its bucket. No task has to see a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def running_sum(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` per group in (``bucket``, ``order``)."""
    key, inner = ", ".join(by), ", ".join([*by, "_bucket"])
    df = df.selectExpr("*", f"{bucket} AS _bucket")
    local = df.selectExpr(
        "*", f"sum({value}) OVER (PARTITION BY {inner} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _local"
    )
    totals = df.groupBy(*by, "_bucket").agg(F.expr(f"sum({value}) AS _total"))
    before = totals.selectExpr(
        *by, "_bucket",
        f"coalesce(sum(_total) OVER (PARTITION BY {key} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
    )
    return local.join(before, [*by, "_bucket"]).selectExpr("* EXCEPT (_bucket, _local, _before)", f"_local + _before AS {out}")


def run_length(df: DataFrame, by: list[str], bucket: str, order: list[str], flag: str, out: str) -> DataFrame:
    """Number of consecutive rows with ``flag`` up to and including the row; 0 where it is false."""
    key, inner, sort = ", ".join(by), ", ".join([*by, "_bucket"]), ", ".join(order)
    running = f"OVER (PARTITION BY {inner} ORDER BY {sort} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = df.selectExpr("*", f"{bucket} AS _bucket", f"IF({flag}, 1, 0) AS _on")
    df = df.selectExpr("*", f"sum(1 - _on) {running} AS _island", f"row_number() OVER (PARTITION BY {inner} ORDER BY {sort}) AS _pos")
    df = df.selectExpr("*", f"max(IF(_on = 0, _pos, 0)) {running} AS _last_off")
    df = df.selectExpr("*", "_pos - _last_off AS _run")
    # Per bucket: the run its last row ends with, and whether anything broke the run inside it.
    ends = df.groupBy(*by, "_bucket").agg(F.expr("max_by(_run, _pos) AS _tail"), F.expr("max(_island) > 0 AS _broken"))
    over = f"OVER (PARTITION BY {key} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ends = ends.selectExpr("*", f"sum(IF(_broken, 1, 0)) {over} AS _epoch")
    ends = ends.selectExpr(
        *by, "_bucket",
        f"sum(_tail) OVER (PARTITION BY {key}, _epoch ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _carry_out",
    )
    carry = ends.selectExpr(*by, "_bucket", f"lag(_carry_out, 1, 0) OVER (PARTITION BY {key} ORDER BY _bucket) AS _carry")
    out_value = "CASE WHEN _on = 0 THEN 0 WHEN _island = 0 THEN _run + _carry ELSE _run END"
    return df.join(carry, [*by, "_bucket"]).selectExpr(
        "* EXCEPT (_bucket, _on, _island, _pos, _last_off, _run, _carry)", f"{out_value} AS {out}"
    )


def trailing_count(df: DataFrame, by: list[str], ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the group in the last ``seconds`` before and including the row's own time.

    Time is cut into buckets of that width. A row is copied to its own bucket and the next one, so every
    trailing span lies inside one bucket; the count is kept only for the row's own copy.
    """
    inner = ", ".join([*by, "_bucket"])
    own = f"unix_micros({ts}) DIV {seconds * 1_000_000}"
    df = df.selectExpr("*", f"explode(array({own}, {own} + 1)) AS _bucket")
    counted = df.selectExpr(
        "*",
        f"count(*) OVER (PARTITION BY {inner} ORDER BY unix_micros({ts}) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS {out}",
    )
    return counted.where(f"_bucket = {own}").drop("_bucket")


def drawdown(df: DataFrame, by: list[str], bucket: str, order: list[str], ret: str, out: str = "drawdown", equity: str = "equity", start: float | None = None) -> DataFrame:
    """Compounded equity of ``1 + ret`` and its drop from the running peak; ``start`` counts as the first peak when given.

    A bucket is summed up by its product and its highest point, both relative to its start. The product before a bucket scales
    its points, and the highest scaled point before it is the peak it starts with. As in a window, rows without a return leave equity as it is.
    """
    key, inner = ", ".join(by), ", ".join([*by, "_bucket"])
    local = f"OVER (PARTITION BY {inner} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"OVER (PARTITION BY {key} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    df = df.selectExpr("*", f"{bucket} AS _bucket", f"1 + coalesce({ret}, 0D) AS _factor")
    frame = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_rise", F.product("_factor").over(frame))
    ends = df.groupBy(*by, "_bucket").agg(F.product("_factor").alias("_product"), F.max("_rise").alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_scale", F.coalesce(F.product("_product").over(earlier), F.lit(1.0)))
    ends = ends.selectExpr(*by, "_bucket", "_scale", f"max(_top * _scale) {before} AS _peak")
    joined = df.join(ends, [*by, "_bucket"]).selectExpr("*", f"_scale * _rise AS {equity}")
    first = "" if start is None else f", {float(start)!r}D"
    joined = joined.selectExpr("*", f"greatest(max({equity}) {local}, _peak{first}) AS _high")
    return joined.selectExpr("* EXCEPT (_bucket, _factor, _rise, _scale, _peak, _high)", f"try_divide({equity} - _high, _high) AS {out}")


def in_blocks(df: DataFrame, by: str, bucket: str, order: list[str], size: int, halo: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(df)`` for window features per ``by`` that look back at most ``halo`` rows, in blocks of ``size`` rows.

    Rows are numbered per group by bucket counts, cut into blocks, and the last ``halo`` rows of a block are copied to the
    next one. ``build`` sees ``by`` as (group, block), so a group of any length is spread over many tasks; copies are dropped after it.
    """
    if halo > size:
        raise ValueError("a block must be at least as long as its halo")
    numbered = running_sum(df.selectExpr("*", "1 AS _one"), [by], bucket, order, "_one", "_row").drop("_one")
    own = f"(_row - 1) DIV {size}"
    copied = numbered.selectExpr("*", f"explode(IF((_row - 1) % {size} >= {size - halo}, array({own}, {own} + 1), array({own}))) AS _block")
    copied = copied.selectExpr(f"* EXCEPT ({by}, _block, _row)", f"struct({by} AS value, _block AS block) AS {by}", f"_block = {own} AS _own")
    built = build(copied).where("_own")
    return built.select(*[F.col(f"{by}.value").alias(by) if c == by else F.col(c) for c in built.columns if c != "_own"])
