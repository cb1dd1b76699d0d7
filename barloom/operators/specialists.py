"""Closed-form specialists: fitted by one aggregate per group, scored by a join and a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions.sliding import span_quantiles
from barloom.functions.text import div
from barloom.operators import moments

# Feature families the rule specialist chooses from, in order of preference between equals.
MOMENTUM = [
    "return_1d", "log_return_1d", "return_3d", "log_return_3d", "return_5d", "log_return_5d", "return_10d", "log_return_10d",
    "return_20d", "log_return_20d", "return_50d", "log_return_50d", "momentum_5d", "momentum_10d", "momentum_20d",
]
RSI = ["rsi_14", "rsi_30"]
MA_RATIO = ["ma_5_ratio", "ma_10_ratio", "ma_20_ratio", "ma_50_ratio", "ma_200_ratio"]
NEWS = [
    "news_price_divergence", "news_count_1d", "news_count_3d", "news_count_7d", "news_count_14d",
    "news_sentiment_3d", "news_sentiment_7d", "news_sentiment_14d",
]


def _rho(x: str, y: str) -> str:
    return div(f"covar_samp({x}, {y})", f"stddev_samp({x}) * stddev_samp({y})")


def fit_rules(
    train: DataFrame, target: str, by: list[str] = ["symbol"], momentum: list[str] = MOMENTUM, rsi: list[str] = RSI,
    ma: list[str] = MA_RATIO, quantile: str = "percentile",
) -> DataFrame:
    """Per group the feature of each family with the largest absolute correlation, and its thresholds.

    One wide aggregate, so rows are not multiplied by features. A group is a symbol or one of its windows,
    bounded by the calendar; for a group pooled over many symbols pass ``quantile='percentile_approx'``.
    """
    cuts = rule_cuts(momentum, rsi)
    aggs = [F.expr(f"abs({_rho(c, target)}) AS _r_{c}") for c in [*momentum, *rsi, *ma]]
    aggs += [F.expr(f"{quantile}({c}, {q}) AS _q{i}_{c}") for c, qs in cuts.items() for i, q in enumerate(qs)]
    return pick_rules(train.groupBy(*by).agg(*aggs), by, momentum, rsi, ma)


def pick_rules(stats: DataFrame, by: list[str], momentum: list[str] = MOMENTUM, rsi: list[str] = RSI, ma: list[str] = MA_RATIO) -> DataFrame:
    """The best feature of each family and its thresholds, from absolute correlations ``_r_*`` and quantiles ``_q*_*``."""

    def best(family: list[str], n_cuts: int) -> str:
        rows = []
        for k, c in enumerate(family):
            qs = "".join(f", _q{i}_{c} AS q{i}" for i in range(n_cuts))
            rows.append(f"struct(coalesce(round(_r_{c}, 12), -1D) AS r, {-k} AS k, '{c}' AS name{qs})")
        return f"array_max(array({', '.join(rows)}))"

    out = stats.selectExpr(*by, f"{best(momentum, 1)} AS _m", f"{best(rsi, 2)} AS _s", f"{best(ma, 0)} AS _a")
    return out.selectExpr(
        *by, "_m.name AS momentum_col", "_m.q0 AS momentum_threshold", "_s.name AS rsi_col", "_s.q0 AS rsi_oversold",
        "_s.q1 AS rsi_overbought", "_a.name AS ma_col", "1D AS ma_threshold",
    )


def rule_cuts(momentum: list[str] = MOMENTUM, rsi: list[str] = RSI) -> dict[str, tuple[float, ...]]:
    """The quantiles of each feature that its family's rule compares with."""
    return {**{c: (0.6,) for c in momentum}, **{c: (0.2, 0.8) for c in rsi}}


#: Typical values, subtracted before squares are summed.
CENTRES = {**{c: 50.0 for c in RSI}, **{c: 1.0 for c in MA_RATIO}}


def walk_forward_fits(
    rows: DataFrame, windows: DataFrame, target: str, train_days: int = RESEARCH.train_days, test_days: int = RESEARCH.test_days,
    momentum: list[str] = MOMENTUM, rsi: list[str] = RSI, ma: list[str] = MA_RATIO, news: list[str] = NEWS,
) -> DataFrame:
    """Rules and news weights of every (symbol, window_id) from bucket sums and one sliding pass; ``rows`` have ``bucket``."""
    by = ["symbol", "window_id"]
    sums = moments.window_moments(rows, windows, [*momentum, *rsi, *ma, *news], [target], train_days, test_days, CENTRES)
    days = moments.bucket_days(train_days, test_days)
    cuts = span_quantiles(rows, rule_cuts(momentum, rsi), train_days // days, test_days // days)
    rates = [f"abs({moments.correlation(c, target)}) AS _r_{c}" for c in [*momentum, *rsi, *ma]]
    weights = [f"coalesce({moments.correlation(c, target)}, 0D) AS w_{c}" for c in news]
    stats = sums.selectExpr(*by, *rates, *weights).join(cuts, by)
    return pick_rules(stats, [*by, *(f"w_{c}" for c in news)], momentum, rsi, ma)


def _picked(name: str, family: list[str]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{c}' THEN {c}" for c in family) + " END"


def score_rules(
    df: DataFrame, rules: DataFrame, by: list[str] = ["symbol"], min_confidence: float = RESEARCH.min_confidence,
    momentum: list[str] = MOMENTUM, rsi: list[str] = RSI, ma: list[str] = MA_RATIO,
) -> DataFrame:
    """Votes of 0.4, plus or minus 0.3, and 0.3; a positive sum means up. Confidence is always 0.5."""
    out = df.join(rules, by).selectExpr("*", f"{_rule_prob(momentum, rsi, ma)} AS prob_up", "0.5D AS confidence")
    keep = [c for c in df.columns if c not in ("signal", "model")]
    return out.selectExpr(*keep, "'rules' AS model", "prob_up", "confidence", f"{_rule_signal(min_confidence)} AS signal")


def _rule_prob(momentum: list[str], rsi: list[str], ma: list[str]) -> str:
    r = _picked("rsi_col", rsi)
    votes = (
        f"IF({_picked('momentum_col', momentum)} > momentum_threshold, 0.4D, 0D) "
        f"+ (IF({r} < rsi_oversold, 0.3D, 0D) + IF({r} > rsi_overbought, -0.3D, 0D)) "
        f"+ IF({_picked('ma_col', ma)} > ma_threshold, 0.3D, 0D)"
    )
    return f"IF({votes} > 0, 1D, 0D)"


def _rule_signal(min_confidence: float) -> str:
    return f"CASE WHEN confidence < {min_confidence} THEN 0 WHEN prob_up > 0.5D THEN 1 ELSE -1 END"


def _sentiment_prob(features: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0D) * w_{c}" for c in features)
    return f"greatest(0D, least(1D, (({total}) + 1) / 2))"


def _sentiment_signal(min_confidence: float) -> str:
    return f"CASE WHEN confidence < {min_confidence} THEN 0 WHEN prob_up > 0.5D THEN 1 WHEN prob_up < 0.5D THEN -1 ELSE 0 END"


def score_both(
    fitted: DataFrame, rule_confidence: float, news_confidence: float, momentum: list[str] = MOMENTUM, rsi: list[str] = RSI,
    ma: list[str] = MA_RATIO, news: list[str] = NEWS,
) -> DataFrame:
    """A row of each specialist per row of ``fitted``, which has features, rules and news weights: one pass, no union."""
    both = fitted.selectExpr("*", f"{_rule_prob(momentum, rsi, ma)} AS _rules", f"{_sentiment_prob(news)} AS _tone")
    used = {"momentum_col", "momentum_threshold", "rsi_col", "rsi_oversold", "rsi_overbought", "ma_col", "ma_threshold", *(f"w_{c}" for c in news)}
    keep = [c for c in fitted.columns if c not in used]
    long = both.selectExpr(*keep, "inline(array(struct('rules' AS model, _rules AS prob_up, 0.5D AS confidence), struct('sentiment' AS model, _tone AS prob_up, 2 * abs(_tone - 0.5D) AS confidence)))")
    return long.selectExpr("*", f"IF(model = 'rules', {_rule_signal(rule_confidence)}, {_sentiment_signal(news_confidence)}) AS signal")


def fit_sentiment(train: DataFrame, target: str, by: list[str] = ["symbol"], features: list[str] = NEWS) -> DataFrame:
    """Correlation of each news feature with the target; 0 where it is undefined. Needs no quantile, so it pools to any size."""
    aggs = [F.expr(f"coalesce({_rho(c, target)}, 0D) AS w_{c}") for c in features]
    if by:
        return train.groupBy(*by).agg(*aggs)
    return train.agg(*aggs)


def score_sentiment(
    df: DataFrame, weights: DataFrame, by: list[str] = ["symbol"], features: list[str] = NEWS,
    min_confidence: float = RESEARCH.min_confidence,
) -> DataFrame:
    """Weighted sum of news features mapped from [-1, 1] to a probability."""
    if by:
        joined = df.join(weights, by)
    else:
        # Pooled weights are one row, keyed by a constant.
        one = F.broadcast(weights.selectExpr("*", "0 AS _pool"))
        joined = df.selectExpr("*", "0 AS _pool").join(one, "_pool")
    keep = [c for c in df.columns if c not in ("signal", "model")]
    out = joined.selectExpr(*keep, f"{_sentiment_prob(features)} AS prob_up")
    out = out.selectExpr("*", "'sentiment' AS model", "2 * abs(prob_up - 0.5D) AS confidence")
    return out.selectExpr("*", f"{_sentiment_signal(min_confidence)} AS signal")
