"""Hostile synthetic paths, every path of every symbol at once, and the survival test over them.

A path is one row of arrays (``ret``, ``regime``, ``position``) keyed by ``(symbol, path_type, path_id)``;
``explode_paths`` gives the long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions import rolling as R
from barloom.functions.text import keyed_draw, keyed_normal, keyed_uniform
from barloom.operators.persistence import regime_runs
from barloom.operators.resample import bind, curve_stats, series_arrays, spread

_COLUMNS = ("symbol", "path_type", "path_id", "ret", "regime", "position")


def _draw(seed: int, kind: str, *key: str) -> str:
    return keyed_draw(f"'{seed}'", f"'{kind}'", "symbol", "path_id", *key)


def crisis_returns(df: DataFrame, n: int = 20, q: float = 0.8, minimum: int = 20) -> DataFrame:
    """Returns of the most volatile days per symbol in date order, or of the lowest tenth of returns if those days number under ``minimum``.

    ``definition`` tells which: 'volatile' or 'lowest'.
    """
    df = df.selectExpr("symbol", "date", "ret", f"{R.std('ret', n)} AS _v")
    whole = "OVER (PARTITION BY symbol)"
    df = df.selectExpr("*", f"percentile(_v, {q}) {whole} AS _q", f"percentile(ret, 0.1) {whole} AS _low")
    arrays = df.groupBy("symbol").agg(
        F.expr("array_sort(collect_list(IF(_v > _q, struct(date, ret), NULL))).ret AS _wild"),
        F.expr("array_sort(collect_list(IF(ret < _low, struct(date, ret), NULL))).ret AS _bad"),
    )
    return arrays.selectExpr("symbol", f"IF(size(_wild) < {minimum}, _bad, _wild) AS crisis", f"IF(size(_wild) < {minimum}, 'lowest', 'volatile') AS definition")


def _finish(df: DataFrame, kind: str, ret: str, regime: str, position: str) -> DataFrame:
    made = bind(df, f"{ret} AS _ret", f"{regime} AS _regime", f"{position} AS _position")
    return made.selectExpr("symbol", f"'{kind}' AS path_type", "path_id", "_ret AS ret", "_regime AS regime", "_position AS position")


def regime_bootstrap(df: DataFrame, n_paths: int = 10, n_days: int = 500, seed: int = RESEARCH.seed) -> DataFrame:
    """Whole regime runs drawn with replacement until ``n_days`` are filled.

    The shortest run bounds the number of draws that can be needed. The calendar of the path is its own,
    so the strategy is long throughout.
    """
    runs = regime_runs(df.select("symbol", "date", "regime")).groupBy("symbol").agg(
        F.expr("array_sort(collect_list(struct(run_id, regime, CAST(duration AS INT) AS len))) AS _runs")
    )
    first = "transform(sequence(1, size(_runs)), k -> aggregate(slice(_runs, 1, k - 1), 1, (a, r) -> a + r.len))"
    runs = runs.selectExpr("symbol", "_runs", f"{first} AS _first", "array_min(_runs.len) AS _min")
    arrays = series_arrays(df, ["ret"]).join(runs, "symbol")
    draws = f"transform(sequence(0, CAST(ceil({n_days} / _min) AS INT) - 1), k -> CAST({_draw(seed, 'runs', 'k')} % size(_runs) AS INT))"
    out = bind(spread(arrays, n_paths), f"{draws} AS _picks")
    ret = f"slice(flatten(transform(_picks, d -> slice(ret, _first[d], _runs[d].len))), 1, {n_days})"
    regime = f"slice(flatten(transform(_picks, d -> array_repeat(_runs[d].regime, _runs[d].len))), 1, {n_days})"
    return _finish(out, "RegimeBootstrap", ret, regime, f"array_repeat(1D, {n_days})")


def crisis_stitch(df: DataFrame, n_paths: int = 10, n_crises: int = 3, length: int = 20, amplify: float = 1.5, seed: int = RESEARCH.seed, minimum: int = 20) -> DataFrame:
    """Blocks of amplified crisis returns laid over the history; later blocks overwrite earlier ones."""
    arrays = series_arrays(df, ["ret", "position"]).join(crisis_returns(df, minimum=minimum), "symbol").where(f"n > {2 * length} AND size(crisis) > 0")
    points = [f"CAST({length} + {_draw(seed, 'point', str(c))} % (n - {2 * length}) AS INT) AS _p{c}" for c in range(n_crises)]
    out = bind(spread(arrays, n_paths), f"least({length}, size(crisis)) AS _len", *points)
    cases = " ".join(
        f"WHEN i >= _p{c} AND i < _p{c} + _len THEN {amplify!r}D * crisis[CAST({_draw(seed, 'day', str(c), f'i - _p{c}')} % size(crisis) AS INT)]"
        for c in reversed(range(n_crises))
    )
    stitched = f"transform(sequence(0, n - 1), i -> CASE {cases} ELSE ret[i] END) AS _stitched"
    out = bind(out, stitched).selectExpr("symbol", "path_id", "n", "position", "_stitched AS ret")
    window = "transform(sequence(0, n - 1), i -> IF(i < 4, NULL, slice(ret, i - 3, 5)))"
    means = f"transform({window}, w -> struct(w AS w, aggregate(w, 0D, (s, x) -> s + x) / 5 AS m))"
    vols = f"transform({means}, z -> sqrt(aggregate(z.w, 0D, (s, x) -> s + (x - z.m) * (x - z.m)) / 4))"
    out = bind(bind(out, f"{vols} AS _v"), "sort_array(filter(_v, x -> x IS NOT NULL)) AS _o")
    at = "(0.8D * (size(_o) - 1))"
    out = bind(
        out, f"get(_o, CAST(floor({at}) AS INT)) + (get(_o, CAST(ceil({at}) AS INT)) - get(_o, CAST(floor({at}) AS INT))) * ({at} - floor({at})) AS _q"
    )
    return _finish(out, "CrisisStitch", "ret", "transform(_v, x -> IF(round(x, 9) > round(_q, 9), 'HOSTILE', 'NEUTRAL'))", "position")


def back_to_back_crisis(df: DataFrame, n_paths: int = 3, n_days: int = 100, seed: int = RESEARCH.seed) -> DataFrame:
    """Nothing but crisis days drawn with replacement, long throughout."""
    out = spread(crisis_returns(df).where("size(crisis) > 0"), n_paths)
    ret = f"transform(sequence(0, {n_days - 1}), i -> crisis[CAST({_draw(seed, 'back', 'i')} % size(crisis) AS INT)])"
    return _finish(out, "BackToBackCrisis", ret, f"array_repeat('HOSTILE', {n_days})", f"array_repeat(1D, {n_days})")


def whipsaw(df: DataFrame, n_paths: int = 10, slowest: int = 3, seed: int = RESEARCH.seed) -> DataFrame:
    """Regime flips every ``slowest + path_id`` days; the day before a flip is amplified by 1.5 to 2.5."""
    out = spread(series_arrays(df, ["ret", "position"]), n_paths).selectExpr("*", f"{slowest} + path_id AS _f")
    factor = "(1.5D + " + keyed_uniform(f"'{seed}'", "'whip'", "symbol", "path_id", "i") + ")"
    ret = f"transform(ret, (x, i) -> IF((i + 1) % _f = 0 AND i < n - 1, x * {factor}, x))"
    regime = "transform(ret, (x, i) -> IF(floor(i / _f) % 2 = 0, 'HOSTILE', 'NEUTRAL'))"
    return _finish(out, "Whipsaw", ret, regime, "position")


def false_risk_off(df: DataFrame, n_paths: int = 5, seed: int = RESEARCH.seed) -> DataFrame:
    """A steady rally labelled hostile."""
    out = spread(series_arrays(df, ["ret", "position"]), n_paths)
    ret = f"transform(ret, (x, i) -> {keyed_normal(0.002, 0.01, f'{chr(39)}{seed}{chr(39)}', chr(39) + 'rally' + chr(39), 'symbol', 'path_id', 'i')})"
    return _finish(out, "FalseRiskOff", ret, "transform(ret, x -> 'HOSTILE')", "position")


def correlation_shock(df: DataFrame, n_paths: int = 1, seed: int = RESEARCH.seed) -> DataFrame:
    """Every symbol follows one common Gaussian path with a little noise of its own."""
    out = spread(series_arrays(df, ["ret", "position"]), n_paths)
    key = f"'{seed}'"
    common = keyed_normal(0.0, 0.02, key, "'common'", "path_id", "i")
    noise = keyed_normal(0.0, 0.002, key, "'noise'", "symbol", "path_id", "i")
    return _finish(out, "CorrShock", f"transform(ret, (x, i) -> {common} + {noise})", "transform(ret, x -> 'NEUTRAL')", "position")


def hostile_suite(df: DataFrame, n_paths: int = 10, seed: int = RESEARCH.seed) -> DataFrame:
    """All path families for the survival test."""
    out = regime_bootstrap(df, n_paths, seed=seed)
    for family in (
        crisis_stitch(df, n_paths, seed=seed), back_to_back_crisis(df, 3, seed=seed), whipsaw(df, n_paths, seed=seed),
        false_risk_off(df, 5, seed=seed),
    ):
        out = out.unionByName(family)
    return out


def explode_paths(paths: DataFrame) -> DataFrame:
    """Long form ``(symbol, path_type, path_id, t, ret, regime, position)``."""
    return paths.selectExpr("symbol", "path_type", "path_id", "posexplode(arrays_zip(ret, regime, position)) AS (t, z)").selectExpr(
        "symbol", "path_type", "path_id", "t", "z.ret AS ret", "z.regime AS regime", "z.position AS position"
    )


def path_results(paths: DataFrame, catastrophic: float = -0.25) -> DataFrame:
    df = paths.select("symbol", "path_type", "path_id", curve_stats(-0.02)("ret", "position").alias("_c"))
    df = df.selectExpr("symbol", "path_type", "path_id", "_c.max_dd", "_c.final_return")
    return df.selectExpr("*", f"max_dd > {catastrophic} AS survived")


def survival(results: DataFrame, pass_at: float = 0.95) -> DataFrame:
    """Survival rate and worst path per symbol."""
    out = results.groupBy("symbol").agg(
        F.expr("count(*) AS paths_tested"), F.expr("count_if(survived) AS survived"), F.expr("avg(IF(survived, 1D, 0D)) AS survival_rate"),
        F.expr("min(max_dd) * 100 AS worst_dd"), F.expr("min(struct(round(max_dd, 9) AS max_dd, path_type)).path_type AS worst_path"),
    )
    return out.selectExpr(
        "*", f"survival_rate >= {pass_at} AS passed"
    )
