"""Text helpers for the DuckDB statements."""

from __future__ import annotations

W = "(PARTITION BY symbol ORDER BY date)"
RUN = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frame(n: int, part: str = "symbol", order: str = "date") -> str:
    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, part: str = "symbol", order: str = "date") -> str:
    w = frame(n, part, order)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {fn}({x}) OVER {w} END"


def roll_q(x: str, q: float, n: int) -> str:
    w = frame(n)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN quantile_cont({x}, {q}) OVER {w} END"


def lag(x: str, n: int = 1, part: str = "symbol", order: str = "date") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {part} ORDER BY {order})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER {W}"


def sdiv(a: str, b: str, fill: str = "0e0") -> str:
    return f"coalesce(({a}) / nullif({b}, 0), {fill})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def change(x: str, n: int) -> str:
    return f"({div(x, lag(x, n))} - 1)"


def draw(*key: str) -> str:
    text = ", '|', ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"('0x' || substr(md5(concat({text})), 1, 8))::BIGINT"


def uniform(*key: str) -> str:
    return f"({draw(*key)} / 4294967296e0)"


def normal(mean: float, sigma: float, *key: str) -> str:
    u1 = f"(({draw(*key, chr(39) + 'a' + chr(39))} + 1e0) / 4294967297e0)"
    u2 = uniform(*key, "'b'")
    return f"({mean}::DOUBLE + {sigma}::DOUBLE * (sqrt(-2e0 * ln({u1})) * cos(2e0 * pi() * {u2})))"
