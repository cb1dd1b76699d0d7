"""Price bar sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def normalize_bars(df: DataFrame, tie_breaker: list[str] | None = None) -> DataFrame:
    """Lower-case names, one row per ``(symbol, date)``, the first by ``tie_breaker``.

    A ``min_by`` aggregate keeps one candidate per task before the shuffle, so a date with very many
    copies never gathers in one place, as it would under ``row_number``.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    values = [c for c in df.columns if c not in ("symbol", "date")]
    order = [c.lower() for c in (tie_breaker or [])] + [c for c in values if c not in (tie_breaker or [])]
    kept = [c for c in values if c not in (tie_breaker or []) or c in ("open", "high", "low", "close", "volume")]
    first = df.groupBy("symbol", F.expr("CAST(date AS DATE)").alias("date")).agg(
        F.expr(f"min_by(struct({', '.join(kept)}), struct({', '.join(order)})) AS _row")
    )
    return first.select("symbol", "date", "_row.*")


def read_bars(spark: SparkSession, path: str | list[str], fmt: str = "parquet", tie_breaker: list[str] | None = None) -> DataFrame:
    """Bars of many symbols from one (partitioned) path or a list of files in one scan."""
    reader = spark.read.format(fmt).schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return normalize_bars(reader.load(path), tie_breaker)


def benchmark(bars: DataFrame, symbol: str | None = None, years: int = 5) -> DataFrame:
    """The benchmark's last ``years`` years, counted back from its latest bar."""
    df = bars.where(F.col("symbol") == symbol) if symbol else bars
    return df.sparkSession.sql(
        "SELECT * FROM {bars} WHERE date >= (SELECT add_months(max(date), CAST({months} AS INT)) FROM {bars})", bars=df, months=-12 * years
    )


def partition_by_symbol(bars: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash bars by symbol into a fixed number of partitions before a feature build.

    Bars are few bytes but feed many window frames; adaptive coalescing sizes tasks by bytes and would
    put them into too few tasks.
    """
    return bars.repartition(partitions or bars.sparkSession.sparkContext.defaultParallelism, "symbol")


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "symbol", mode: str = "overwrite") -> None:
    """Write a result as parquet, csv or json, one folder per symbol when ``partition`` is given."""
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)
