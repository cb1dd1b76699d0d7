"""Rolling windows with full-window semantics, as SQL expression text for ``selectExpr``.

A statistic over ``n`` bars is null until ``n`` non-null values are in the frame. All helpers share one
window specification per key, so Spark plans one exchange and one sort for a whole feature build, and the
text form costs one driver call per select instead of several per expression. A partition holds the bars
of one symbol; ``(symbol, date)`` is unique, so its size is bounded by the trading calendar, whatever the
volume of the raw data.
"""

from __future__ import annotations

import math

from barloom.config import TRADING_DAYS
from barloom.functions.text import div

KEY, ORDER = "symbol", "date"


def over(key: str = KEY, order: str = ORDER, rows: str = "") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order}{' ROWS BETWEEN ' + rows if rows else ''})"


def frame(n: int, key: str = KEY, order: str = ORDER) -> str:
    return over(key, order, f"{n - 1} PRECEDING AND CURRENT ROW")


def running(key: str = KEY, order: str = ORDER) -> str:
    return over(key, order, "UNBOUNDED PRECEDING AND CURRENT ROW")


def lag(x: str, n: int = 1, key: str = KEY, order: str = ORDER) -> str:
    return f"lag({x}, {n}) {over(key, order)}"


def lead(x: str, n: int = 1, key: str = KEY, order: str = ORDER) -> str:
    return f"lead({x}, {n}) {over(key, order)}"


def full(agg: str, x: str, n: int, key: str = KEY, order: str = ORDER) -> str:
    f = frame(n, key, order)
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


def mean(x: str, n: int, key: str = KEY) -> str:
    return full("avg", x, n, key)


def std(x: str, n: int, key: str = KEY) -> str:
    return full("stddev_samp", x, n, key)


def change(x: str, n: int, key: str = KEY) -> str:
    return f"(try_divide({x}, {lag(x, n, key)}) - 1)"


def correlation(x: str, y: str, n: int, key: str = KEY) -> str:
    """Pearson over complete pairs; null unless all ``n`` pairs are complete and both sides vary."""
    xm, ym = f"IF(({y}) IS NOT NULL, {x}, NULL)", f"IF(({x}) IS NOT NULL, {y}, NULL)"
    f = frame(n, key)
    value = div(f"covar_samp({xm}, {ym}) {f}", f"stddev_samp({xm}) {f} * stddev_samp({ym}) {f}")
    return f"CASE WHEN count({xm}) {f} = {n} THEN {value} END"


def slope_ratio(x: str, y: str, n: int, key: str = KEY) -> str:
    """cov(x, y) / var(y): correlation times the ratio of volatilities, over complete pairs."""
    xm, ym = f"IF(({y}) IS NOT NULL, {x}, NULL)", f"IF(({x}) IS NOT NULL, {y}, NULL)"
    f = frame(n, key)
    return f"CASE WHEN count({xm}) {f} = {n} THEN {div(f'covar_samp({xm}, {ym}) {f}', f'var_samp({ym}) {f}')} END"


def back_fill(x: str, key: str = KEY) -> str:
    return f"first_value({x}) IGNORE NULLS {over(key, rows='CURRENT ROW AND UNBOUNDED FOLLOWING')}"


def forward_fill(x: str, key: str = KEY) -> str:
    return f"last_value({x}) IGNORE NULLS {running(key)}"


def sharpe(x: str, n: int, key: str = KEY) -> str:
    """Annualised rolling mean over rolling sample deviation, 0 where undefined."""
    return f"coalesce({div(mean(x, n, key), std(x, n, key))} * {math.sqrt(TRADING_DAYS)!r}D, 0D)"


def gain_loss(delta: str, n: int, key: str = KEY) -> tuple[str, str]:
    """Simple-mean average gain and loss of a price change; the first row counts as no move."""
    gain = f"IF({delta} > 0, {delta}, 0D)"
    loss = f"IF({delta} < 0, -{delta}, 0D)"
    return mean(gain, n, key), mean(loss, n, key)
