"""Registration of queries and of the DuckDB statements they are checked against.

``cols`` lists the output columns for both sides: ``name`` as it is, ``name:6`` a double rounded to six
places, ``name:i`` a 64-bit integer, ``name:b`` a boolean, ``name:s`` a string, ``name:d`` a date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloads.oracle import ORACLE_VIEWS
from workloads.views import Inputs, duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STATEMENTS: dict[str, tuple[str, str]] = {}
_TYPES = {"i": "BIGINT", "b": "BOOLEAN", "s": "VARCHAR", "d": "DATE"}


def _specs(cols: str) -> list[tuple[str, str | None]]:
    return [tuple(c.split(":")) if ":" in c else (c, None) for c in cols.split()]


def _spark_column(name: str, kind: str | None) -> str:
    if kind is None:
        return name
    if kind in _TYPES:
        return f"CAST({name} AS {'STRING' if kind == 's' else _TYPES[kind]}) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind}) + 0D AS {name}"


def _duck_column(name: str, kind: str | None) -> str:
    if kind is None:
        return name
    if kind in _TYPES:
        return f"CAST({name} AS {_TYPES[kind]}) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind}) + 0e0 AS {name}"


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(t: Inputs) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir)).selectExpr(*[_spark_column(n, k) for n, k in _specs(cols)])

        QUERIES[name] = run
        if sql is not None:
            _STATEMENTS[name] = (cols, sql.strip())
        return fn

    return wrap


def oracle_statements() -> dict[str, str]:
    out = {}
    for name, (cols, sql) in _STATEMENTS.items():
        picked = ", ".join(_duck_column(n, k) for n, k in _specs(cols))
        out[name] = duck_with(f"SELECT {picked} FROM (\n{sql}\n) result", ORACLE_VIEWS)
    return out
