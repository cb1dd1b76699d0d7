"""Leakage tests that fit again: every shifted or shuffled label is fitted from its own moment sums in the walk-forward pass.

Moving finished forecasts can't expose a fit that has seen its outcome. Here the fit itself is given labels of other
bars: a sound model fitted on labels dealt at random finds nothing, and one whose features are made older than its labels
loses what it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions import rolling as R
from barloom.functions.text import keyed_draw
from barloom.operators import moments
from barloom.operators.backtest import net_returns, pnl_metrics, signal_metrics
from barloom.operators.specialists import NEWS

_LABEL, _RETURN = "actual_direction", "actual_return"


def shift_labels(rows: DataFrame, shifts: list[int]) -> DataFrame:
    """``rows`` with ``y_k`` and ``r_k``: label and return ``k`` bars later (features k bars too old), or earlier for negative k."""
    moved = lambda c, k: c if not k else R.lead(c, k) if k > 0 else R.lag(c, -k)
    names = [_name(k) for k in shifts]
    return rows.selectExpr("*", *[f"{moved(_LABEL, k)} AS y_{n}" for k, n in zip(shifts, names)], *[f"{moved(_RETURN, k)} AS r_{n}" for k, n in zip(shifts, names)])


def _name(k: int) -> str:
    return f"early_{-k}" if k < 0 else f"late_{k}"


def shuffle_labels(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """``rows`` with ``y_shuffle_s``: the symbol's labels dealt to its dates in the keyed random order of each seed.

    A symbol's labels, bounded by the calendar, are ordered once per seed in one aggregate and met by one join.
    """
    orders = [f"transform(array_sort(collect_list(struct({keyed_draw(chr(39) + str(s) + chr(39), 'symbol', 'date')} AS d, date, {_LABEL} AS y))), x -> x.y) AS y_shuffle_{s}" for s in seeds]
    names = [f"y_shuffle_{s}" for s in seeds]
    dealt = rows.groupBy("symbol").agg(*map(F.expr, orders)).selectExpr("symbol", f"posexplode(arrays_zip({', '.join(names)})) AS (_at, _y)")
    dealt = dealt.selectExpr("symbol", "_at", *[f"_y.{n} AS {n}" for n in names])
    return rows.selectExpr("*", f"row_number() {R.over()} - 1 AS _at").join(dealt, ["symbol", "_at"]).drop("_at")


def refit(rows: DataFrame, windows: DataFrame, variants: dict[str, tuple[str, str, str]], features: list[str] = NEWS,
          min_confidence: float = 0.1, train_days: int = RESEARCH.train_days, test_days: int = RESEARCH.test_days) -> DataFrame:
    """Metrics per (symbol, variant) of the news specialist fitted again in every window for each variant.

    ``variants``: name to (label it is fitted on, label it is judged by, return it earns), columns of ``rows``, which has ``bucket``.
    Rows where one of these columns is missing, near the ends of a series, count for no variant.
    """
    fitted = sorted({v[0] for v in variants.values()})
    used = sorted({c for v in variants.values() for c in v})
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in used))
    sums = moments.window_moments(rows, windows, features, fitted, train_days, test_days)
    by = ["symbol", "window_id"]
    fits = sums.selectExpr(*by, *[f"coalesce({moments.correlation(c, y)}, 0D) AS w_{y}_{c}" for y in fitted for c in features])
    test = moments.test_rows(rows, windows, train_days, test_days).join(fits, by)
    structs = []
    for name, (label, judged, earned) in variants.items():
        total = " + ".join(f"coalesce({c}, 0D) * w_{label}_{c}" for c in features)
        structs.append(f"struct('{name}' AS variant, greatest(0D, least(1D, (({total}) + 1) / 2)) AS prob_up, CAST({judged} AS INT) AS actual_direction, {earned} AS actual_return)")
    scored = test.selectExpr("symbol", "date", f"inline(array({', '.join(structs)}))").selectExpr("*", "2 * abs(prob_up - 0.5D) AS confidence")
    scored = scored.selectExpr("*", f"CASE WHEN confidence < {min_confidence} THEN 0 WHEN prob_up > 0.5D THEN 1 WHEN prob_up < 0.5D THEN -1 ELSE 0 END AS signal")
    key = ["symbol", "variant"]
    return signal_metrics(scored, key).join(pnl_metrics(net_returns(scored, key), key), key)


def refit_time_shift(rows: DataFrame, windows: DataFrame, shifts: list[int], **settings) -> DataFrame:
    """:func:`refit` with labels moved by each of ``shifts`` and unmoved; judged by the labels it was fitted on."""
    shifts = sorted({0, *shifts})
    variants = {_name(k): (f"y_{_name(k)}", f"y_{_name(k)}", f"r_{_name(k)}") for k in shifts}
    return refit(shift_labels(rows, shifts), windows, variants, **settings)


def refit_label_shuffle(rows: DataFrame, windows: DataFrame, seeds: list[int], **settings) -> DataFrame:
    """:func:`refit` on shuffled labels and on the true ones, judged by the true ones; ``passed`` if the fit found nothing."""
    variants = {"true": (_LABEL, _LABEL, _RETURN)} | {f"shuffle_{s}": (f"y_shuffle_{s}", _LABEL, _RETURN) for s in seeds}
    out = refit(shuffle_labels(rows, seeds), windows, variants, **settings)
    return out.selectExpr("*", "abs(directional_accuracy - 0.5D) < 0.1D AND total_return < 0.05D AS passed")
