"""Scalar SQL expression text shared by the operators."""

from __future__ import annotations

import math


def div(a: str, b: str) -> str:
    """``a / b``, null for a zero denominator (a plain division raises under ANSI mode)."""
    return f"try_divide({a}, {b})"


def safe_div(a: str, b: str, fill: float = 0.0) -> str:
    """``a / b`` with ``fill`` where the denominator is zero or either side is null."""
    return f"coalesce(try_divide({a}, {b}), {float(fill)!r}D)"


def keyed_draw(*key: str) -> str:
    """A 32-bit integer drawn from the md5 of the key expressions: equal on every run and engine."""
    text = ", '|', ".join(f"CAST({k} AS STRING)" for k in key)
    return f"CAST(conv(substr(md5(concat({text})), 1, 8), 16, 10) AS BIGINT)"


def keyed_uniform(*key: str) -> str:
    """Uniform in [0, 1) from :func:`keyed_draw`."""
    return f"({keyed_draw(*key)} / 4294967296D)"


def keyed_normal(mean: float, sigma: float, *key: str) -> str:
    """Gaussian draw by the Box-Muller transform of two keyed uniforms."""
    u1 = f"(({keyed_draw(*key, chr(39) + 'a' + chr(39))} + 1D) / 4294967297D)"
    u2 = keyed_uniform(*key, "'b'")
    return f"({float(mean)!r}D + {float(sigma)!r}D * sqrt(-2D * ln({u1})) * cos({2 * math.pi!r}D * {u2}))"


def keyword_score(text: str, positive: tuple[str, ...], negative: tuple[str, ...]) -> str:
    """(p - n) / (p + n + 1) over distinct word hits; a hit is a substring of the whole lower-cased text."""
    lowered = f"coalesce(lower({text}), '')"

    def hits(words: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"CAST(contains({lowered}, '{w}') AS INT)" for w in words) + ")"

    p, n = hits(positive), hits(negative)
    return f"(({p} - {n}) / CAST({p} + {n} + 1 AS DOUBLE))"


def normal_cdf(z: str) -> str:
    """Standard normal CDF by a rational approximation of erf (absolute error below 1.5e-7)."""
    # Coefficients of the published approximation 7.1.26 in Abramowitz and Stegun.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1D / (1D + {p}D * {x}))"
    poly = f"((((({a5}D * {t} + {a4}D) * {t} + {a3}D) * {t} + {a2}D) * {t} + {a1}D) * {t})"
    erf = f"(1D - {poly} * exp(-{x} * {x}))"
    return f"(0.5D * (1D + IF({z} >= 0, {erf}, -{erf})))"


def grid(rows: list[tuple], fields: list[str]) -> str:
    """A literal array of structs; ``inline(grid)`` multiplies rows by a fixed grid without a join."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, bool):
            return str(v).lower()
        return f"{v!r}D" if isinstance(v, float) else str(v)

    structs = [
        "struct(" + ", ".join(f"{literal(v)} AS {f}" for f, v in zip(fields, row)) + ")" for row in rows
    ]
    return f"array({', '.join(structs)})"
