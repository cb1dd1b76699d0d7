"""How long regimes last and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import rolling as R
from barloom.functions.text import div


def number_runs(df: DataFrame, state: str = "regime", by: str = "symbol", out: str = "run_id") -> DataFrame:
    """Number the maximal runs of equal ``state`` in date order."""
    df = df.selectExpr("*", f"IF({state} <=> {R.lag(state, 1, by)} AND row_number() {R.over(by)} > 1, 0, 1) AS _start")
    return df.selectExpr("* EXCEPT (_start)", f"sum(_start) {R.running(by)} AS {out}")


def regime_runs(df: DataFrame, state: str = "regime", by: str = "symbol") -> DataFrame:
    """One row per run: state, first and last date, number of bars."""
    return number_runs(df, state, by).groupBy(by, "run_id", state).agg(
        F.expr("min(date) AS start_date"), F.expr("max(date) AS end_date"), F.expr("count(*) AS duration")
    )


def regime_durations(df: DataFrame, state: str = "regime", by: str = "symbol") -> DataFrame:
    return regime_runs(df, state, by).groupBy(by, state).agg(
        F.expr("avg(duration) AS avg_duration"),
        F.expr("coalesce(stddev_pop(duration), 0D) AS std_duration"),
        F.expr("min(duration) AS min_duration"), F.expr("max(duration) AS max_duration"),
        F.expr("count(*) AS occurrences"), F.expr("sum(duration) AS total_days"),
    )


def transitions(df: DataFrame, state: str = "regime", by: str = "symbol") -> DataFrame:
    """Transition shares over the full grid of the states a symbol shows; 0 where none was seen.

    The grid is exploded from the set of states of a symbol, a handful by nature of the labels.
    """
    steps = df.selectExpr(by, f"{R.lag(state, 1, by)} AS from_state", f"{state} AS to_state").where("from_state IS NOT NULL")
    counts = steps.groupBy(by, "from_state", "to_state").agg(F.expr("count(*) AS n"))
    states = df.groupBy(by).agg(F.expr(f"collect_set({state}) AS _s"), F.expr("count(*) AS _n")).where("_n >= 2")
    grid = states.selectExpr(by, "_s", "explode(_s) AS from_state").selectExpr(by, "from_state", "explode(_s) AS to_state")
    joined = grid.join(counts, [by, "from_state", "to_state"], "left")
    total = f"sum(n) OVER (PARTITION BY {by}, from_state)"
    return joined.selectExpr(
        by, "from_state", "to_state", "coalesce(n, 0) AS n", f"coalesce({div('CAST(n AS DOUBLE)', total)}, 0D) AS p"
    )


def duration_drift(current: DataFrame, baseline: DataFrame, state: str = "regime", by: str = "symbol", limit: float = 0.3) -> DataFrame:
    """Relative change of the average duration per state; beyond ``limit`` it is significant."""
    base = baseline.selectExpr(by, state, "avg_duration AS _base").where("_base > 0")
    out = current.join(base, [by, state]).selectExpr(by, state, "avg_duration", "_base AS baseline_duration",
                                                     "(avg_duration - _base) / _base AS drift")
    return out.selectExpr("*", f"abs(drift) > {limit} AS significant")
