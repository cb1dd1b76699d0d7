"""Exact quantiles of pools of any size by refining histograms, and rules fitted on such pools.

The sought order statistics are enclosed in intervals. Each pass counts the rows inside every interval in equal bins, with partial
sums per task, and keeps of each interval the bin that holds its rank, from that bin's smallest to its largest value. A rank is found when
its bin holds one value. Only counts per bin leave the tasks, whatever the size of the pool or of a group of equal values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from barloom.operators import moments
from barloom.operators.specialists import CENTRES, MA_RATIO, MOMENTUM, NEWS, RSI, fit_sentiment, pick_rules, rule_cuts, score_rules, score_sentiment

BINS = 1024


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bins: int = BINS) -> dict[tuple[str, int], float]:
    """The value of each 0-based rank among the non-null values of its column."""
    if not any(ranks.values()):
        return {}
    ends = df.agg(*[F.expr(f"{f}({c}) AS {f}_{c}") for c in ranks for f in ("min", "max")]).first()
    #: (column, rank) to (smallest value, largest value, rank inside)
    inside = {(c, r): (ends[f"min_{c}"], ends[f"max_{c}"], r) for c, rs in ranks.items() for r in rs}
    found: dict[tuple[str, int], float] = {}
    while True:
        found |= {at: low for at, (low, high, _) in inside.items() if low == high}
        inside = {at: x for at, x in inside.items() if at not in found}
        if not inside:
            return found
        asked = sorted({(c, low, high) for (c, _), (low, high, _) in inside.items()})
        entries = []
        for k, (c, low, high) in enumerate(asked):
            # halves first, so that the width of an interval of extreme values stays finite
            share = f"(({c} / 2 - {low / 2!r}D) / {high / 2 - low / 2!r}D)"
            entries.append(f"IF({c} >= {low!r}D AND {c} <= {high!r}D, struct({k} AS k, CAST(least({bins - 1}, floor({share} * {bins})) AS INT) AS bin, CAST({c} AS DOUBLE) AS x), NULL)")
        counted = df.selectExpr(f"inline(filter(array({', '.join(entries)}), x -> x IS NOT NULL))").groupBy("k", "bin").agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k", "bin").collect()
        parts: dict[int, list] = {}
        for row in counted:
            parts.setdefault(row.k, []).append(row)
        for at, (low, high, rank) in inside.items():
            for row in parts[asked.index((at[0], low, high))]:
                if rank < row.n:
                    inside[at] = (row.low, row.high, rank)
                    break
                rank -= row.n


def exact_quantiles(df: DataFrame, cuts: dict[str, tuple[float, ...]], bins: int = BINS) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of whole columns; None for a column without values."""
    counts = df.agg(*[F.count(c).alias(c) for c in cuts]).first()
    places = {c: [q * (counts[c] - 1) for q in qs] for c, qs in cuts.items() if counts[c]}
    values = order_statistics(df, {c: sorted({f(p) for p in ps for f in (math.floor, math.ceil)}) for c, ps in places.items()}, bins)
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c, qs in cuts.items()}
    for c, ps in places.items():
        low = [values[c, math.floor(p)] for p in ps]
        out[c] = [a + (values[c, math.ceil(p)] - a) * (p - math.floor(p)) for a, p in zip(low, ps)]
    return out


def fit_pooled_rules(train: DataFrame, target: str, momentum: list[str] = MOMENTUM, rsi: list[str] = RSI, ma: list[str] = MA_RATIO) -> DataFrame:
    """One row: the rules fitted on all rows of ``train`` together; correlations from sums, thresholds by refinement."""
    sums, _ = moments.moment_sums(train, [*momentum, *rsi, *ma], [target], [], CENTRES)
    quantiles = exact_quantiles(train, rule_cuts(momentum, rsi))
    literal = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"{x!r}D"
    stats = sums.selectExpr(*[f"abs({moments.correlation(c, target)}) AS _r_{c}" for c in [*momentum, *rsi, *ma]],
                            *[f"{literal(x)} AS _q{i}_{c}" for c, xs in quantiles.items() for i, x in enumerate(xs)])
    return pick_rules(stats, [], momentum, rsi, ma)


def transfer(df: DataFrame, train_symbols: list[str], target: str = "actual_direction", news: list[str] = NEWS,
             rule_confidence: float = 0.4, news_confidence: float = 0.1) -> DataFrame:
    """Both specialists fitted on the pool of some symbols: accuracy and coverage of each on every other symbol."""
    names = ", ".join(f"'{s}'" for s in train_symbols)
    train, test = df.where(f"symbol IN ({names})"), df.where(f"symbol NOT IN ({names})")
    one = F.broadcast(fit_pooled_rules(train, target).selectExpr("*", "0 AS _pool"))
    rules = score_rules(test.selectExpr("*", "0 AS _pool"), one, ["_pool"], rule_confidence)
    tone = score_sentiment(test, fit_sentiment(train, target, [], news), [], news, news_confidence)
    cols = ["symbol", "model", "signal", target]
    return rules.select(*cols).unionByName(tone.select(*cols)).groupBy("model", "symbol").agg(
        F.expr("count(*) AS n_rows"), F.expr("count_if(signal <> 0) AS trades"),
        F.expr(f"coalesce(try_divide(CAST(count_if(signal <> 0 AND signal = {target}) AS DOUBLE), count_if(signal <> 0)), 0D) AS accuracy"),
        F.expr("avg(IF(signal <> 0, 1D, 0D)) AS coverage"),
    )
