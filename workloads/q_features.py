"""Price, market, news, label and signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import NEGATIVE_WORDS, NEGATIVE_WORDS_TRADE, POSITIVE_WORDS, POSITIVE_WORDS_TRADE
from barloom.functions import scan
from barloom.operators import market, news, price, regimes
from barloom.operators.align import asof_join
from workloads.oracle import ORACLE_VIEWS as V
from workloads.registry import query
from workloads.sqlkit import W, change, div, frame, lag, lead, roll, sdiv

PERIODS = (1, 3, 5, 10, 20, 50)


def _cols(names, places=6) -> str:
    return "symbol date " + " ".join(f"{n}:{places}" for n in names)


@query("price_returns", _cols([f"return_{n}d" for n in PERIODS]),
       "SELECT symbol, date, " + ", ".join(f"{change('close', n)} AS return_{n}d" for n in PERIODS) + " FROM bars")
def _(t):
    return price.price_features(t.bars)


@query("price_log_returns", _cols([f"log_return_{n}d" for n in PERIODS]),
       "SELECT symbol, date, " + ", ".join(f"ln(close / {lag('close', n)}) AS log_return_{n}d" for n in PERIODS) + " FROM bars")
def _(t):
    return price.price_features(t.bars)


@query("price_volatility", _cols([f"volatility_{n}d" for n in (5, 10, 20, 60)]),
       "SELECT symbol, date, " + ", ".join(f"{roll('stddev_samp', 'r1', n)} AS volatility_{n}d" for n in (5, 10, 20, 60)) + " FROM px_ret")
def _(t):
    return price.price_features(t.bars)


@query("price_volatility_by_block", _cols([f"volatility_{n}d" for n in (5, 10, 20, 60)]),
       "SELECT symbol, date, " + ", ".join(f"{roll('stddev_samp', 'r1', n)} AS volatility_{n}d" for n in (5, 10, 20, 60)) + " FROM px_ret")
def _(t):
    return scan.in_blocks(t.bars, "symbol", "year(date)", ["date"], 500, price.LOOK_BACK, price.price_features)


@query("price_realized_vol", _cols([f"realized_vol_{n}d" for n in (5, 10, 20, 60)]),
       "SELECT symbol, date, " + ", ".join(f"({roll('stddev_samp', 'r1', n)}) * sqrt(252e0) AS realized_vol_{n}d" for n in (5, 10, 20, 60)) + " FROM px_ret")
def _(t):
    return price.price_features(t.bars)


@query("price_vol_term_structure", _cols(["vol_term_structure"]),
       f"SELECT symbol, date, {sdiv(roll('stddev_samp', 'r1', 5), roll('stddev_samp', 'r1', 60))} AS vol_term_structure FROM px_ret")
def _(t):
    return price.price_features(t.bars)


MA = (5, 10, 20, 50, 200)
V["ma_rows"] = "SELECT symbol, date, close, " + ", ".join(f"{roll('avg', 'close', n)} AS ma_{n}" for n in MA) + " FROM bars"


@query("price_moving_averages",
       "symbol date " + " ".join(f"ma_{n}:9 ma_{n}_ratio:6 ma_{n}_slope:6" for n in MA),
       "SELECT symbol, date, " + ", ".join(
           f"ma_{n}, {sdiv('close', f'ma_{n}')} AS ma_{n}_ratio, "
           f"{div(f'ma_{n} - ' + lag(f'ma_{n}', 5), lag(f'ma_{n}', 5))} AS ma_{n}_slope" for n in MA) + " FROM ma_rows")
def _(t):
    return price.price_features(t.bars)


@query("price_rsi", _cols(["rsi_14", "rsi_30"]),
       "SELECT symbol, date, " + ", ".join(
           f"100 - 100 / (1 + {sdiv(roll('avg', 'gain', n), roll('avg', 'loss', n))}) AS rsi_{n}" for n in (14, 30)) + " FROM px_tr")
def _(t):
    return price.price_features(t.bars)


@query("price_atr", _cols(["atr_14", "atr_30"], 7),
       "SELECT symbol, date, " + ", ".join(f"{roll('avg', 'tr', n)} AS atr_{n}" for n in (14, 30)) + " FROM px_tr")
def _(t):
    return price.price_features(t.bars)


@query("price_range_gap", _cols(["intraday_range_pct", "overnight_gap_pct", "gap_vs_atr"]),
       f"""SELECT symbol, date, {div('high - low', 'open')} AS intraday_range_pct, {div('open - pc', 'pc')} AS overnight_gap_pct,
       {sdiv('abs(' + div('open - pc', 'pc') + ')', roll('avg', 'tr', 14))} AS gap_vs_atr FROM px_tr""")
def _(t):
    return price.price_features(t.bars)


def _pos(n):
    hi, lo = roll("max", "high", n), roll("min", "low", n)
    return f"{hi} AS high_{n}, {lo} AS low_{n}, {sdiv(f'close - ({lo})', f'({hi}) - ({lo})')} AS price_position_{n}"


@query("price_position", _cols(["high_20", "low_20", "price_position_20", "high_50", "low_50", "price_position_50"]),
       f"SELECT symbol, date, {_pos(20)}, {_pos(50)} FROM bars")
def _(t):
    return price.price_features(t.bars)


@query("price_volume", _cols([x for n in (10, 20, 50) for x in (f"volume_ma_{n}", f"volume_ratio_{n}")]),
       "SELECT symbol, date, " + ", ".join(
           f"{roll('avg', 'volume', n)} AS volume_ma_{n}, {sdiv('volume', roll('avg', 'volume', n))} AS volume_ratio_{n}"
           for n in (10, 20, 50)) + " FROM bars")
def _(t):
    return price.price_features(t.bars)


V["amihud_day"] = f"SELECT *, {sdiv('abs(r1)', 'close * volume')} AS illiq FROM px_ret"
V["amihud_rows"] = f"SELECT *, ({roll('avg', 'illiq', 20)}) * 1e6 AS amihud_illiquidity FROM amihud_day"


@query("price_amihud", _cols(["amihud_illiquidity", "amihud_ma_60", "amihud_rel_60"]),
       f"""SELECT symbol, date, amihud_illiquidity, {roll('avg', 'amihud_illiquidity', 60)} AS amihud_ma_60,
       {sdiv('amihud_illiquidity', roll('avg', 'amihud_illiquidity', 60))} AS amihud_rel_60 FROM amihud_rows""")
def _(t):
    return price.price_features(t.bars)


@query("price_volume_return_corr", _cols(["vol_ret_corr_20"]),
       f"""SELECT symbol, date, CASE WHEN count(v) OVER {frame(20)} = 20 THEN
       covar_samp(v, a) OVER {frame(20)} / nullif(stddev_samp(v) OVER {frame(20)} * stddev_samp(a) OVER {frame(20)}, 0) END AS vol_ret_corr_20
       FROM (SELECT symbol, date, CASE WHEN r1 IS NOT NULL THEN volume END AS v, abs(r1) AS a FROM px_ret) m""")
def _(t):
    return price.price_features(t.bars)


@query("price_bar_ratios", _cols(["high_low_ratio", "close_open_ratio"]),
       f"SELECT symbol, date, {sdiv('high', 'low')} AS high_low_ratio, {sdiv('close', 'open')} AS close_open_ratio FROM bars")
def _(t):
    return price.price_features(t.bars)


@query("price_momentum", _cols(["momentum_5d", "momentum_10d", "momentum_20d"]),
       "SELECT symbol, date, " + ", ".join(f"{change('close', n)} AS momentum_{n}d" for n in (5, 10, 20)) + " FROM bars")
def _(t):
    return price.price_features(t.bars)


def raw_rsi_sql(n: int) -> str:
    g, l = roll("avg", "gain", n), roll("avg", "loss", n)
    return f"CASE WHEN ({l}) = 0 AND ({g}) > 0 THEN 100e0 ELSE 100 - 100 / (1 + {div(g, l)}) END"


V["rsi2_rows"] = f"SELECT symbol, date, {raw_rsi_sql(2)} AS rsi_2 FROM px_tr"


@query("rsi_extreme_signal", "symbol date rsi_2:6 signal:6",
       "SELECT *, CASE WHEN rsi_2 < 10 THEN 1e0 WHEN rsi_2 > 90 THEN -1e0 ELSE 0e0 END AS signal FROM rsi2_rows")
def _(t):
    return price.rsi_extreme_signal(t.bars)


V["asof_dates"] = "SELECT date FROM bars UNION SELECT date FROM index_bars"
V["asof_rows"] = """SELECT b.*, i.close AS index_close FROM px_ret b ASOF LEFT JOIN index_bars i ON b.date >= i.date"""
V["asof_ret"] = "SELECT *, " + ", ".join(f"{change('index_close', n)} AS i{n}" for n in (1, 3, 5, 10, 20)) + " FROM asof_rows"


@query("asof_benchmark", "symbol date close:6 index_close:6", "SELECT symbol, date, close, index_close FROM asof_rows")
def _(t):
    return asof_join(t.bars, t.index_bars)


@query("index_returns", _cols([f"index_return_{n}d" for n in (1, 3, 5, 10)]),
       "SELECT symbol, date, i1 AS index_return_1d, i3 AS index_return_3d, i5 AS index_return_5d, i10 AS index_return_10d FROM asof_ret")
def _(t):
    return market.market_features(price.daily_returns(t.bars), t.index_bars)


@query("relative_strength", _cols([f"relative_strength_{n}d" for n in (5, 10, 20)]),
       "SELECT symbol, date, " + ", ".join(f"{change('close', n)} - i{n} AS relative_strength_{n}d" for n in (5, 10, 20)) + " FROM asof_ret")
def _(t):
    return market.market_features(price.daily_returns(t.bars), t.index_bars)


def _beta(n):
    return (f"CASE WHEN count(x) OVER {frame(n)} = {n} THEN covar_samp(x, y) OVER {frame(n)} / "
            f"nullif(var_samp(y) OVER {frame(n)}, 0) END AS beta_approx_{n}")


@query("rolling_beta", _cols(["beta_approx_20", "beta_approx_60"]),
       f"""SELECT symbol, date, {_beta(20)}, {_beta(60)} FROM (SELECT symbol, date,
       CASE WHEN i1 IS NOT NULL THEN r1 END AS x, CASE WHEN r1 IS NOT NULL THEN i1 END AS y FROM asof_ret) m""")
def _(t):
    return market.market_features(price.daily_returns(t.bars), t.index_bars)


def _hits(words):
    return " + ".join(f"CAST(contains(lower(headline), '{w}') AS INTEGER)" for w in words)


def tone_sql(pos, neg):
    return f"((({_hits(pos)}) - ({_hits(neg)})) / (({_hits(pos)}) + ({_hits(neg)}) + 1e0))"


V["news_scored"] = f"SELECT *, CAST(ts AS DATE) AS date, {tone_sql(POSITIVE_WORDS, NEGATIVE_WORDS)} AS sentiment FROM news"
V["news_day"] = "SELECT symbol, date, count(*) AS news_count, avg(sentiment) AS news_sentiment FROM news_scored GROUP BY 1, 2"
V["news_aligned"] = f"""SELECT symbol, date, close, r1, coalesce({lag('c')}, 0e0) AS n_count, coalesce({lag('s')}, 0e0) AS n_tone FROM (
  SELECT p.*, coalesce(news_count, 0) * 1e0 AS c, coalesce(news_sentiment, 0e0) AS s
  FROM px_ret p LEFT JOIN news_day USING (symbol, date)) j"""
V["news_feature_rows"] = (
    "SELECT symbol, date, "
    + f"n_tone - coalesce({lag('r1')} / nullif({roll('stddev_samp', 'r1', 20)}, 0), 0) AS news_price_divergence, "
    + ", ".join(f"sum(n_count) OVER {frame(n)} AS news_count_{n}d" for n in (1, 3, 7, 14)) + ", "
    + ", ".join(f"avg(n_tone) OVER {frame(n)} AS news_sentiment_{n}d" for n in (3, 7, 14)) + " FROM news_aligned")


@query("headline_sentiment", "doc_id sentiment:6 sentiment_trade:6",
       f"SELECT doc_id, {tone_sql(POSITIVE_WORDS, NEGATIVE_WORDS)} AS sentiment, {tone_sql(POSITIVE_WORDS_TRADE, NEGATIVE_WORDS_TRADE)} AS sentiment_trade FROM news")
def _(t):
    return news.headline_sentiment(
        news.headline_sentiment(t.news), POSITIVE_WORDS_TRADE, NEGATIVE_WORDS_TRADE, "sentiment_trade")


@query("news_daily_aligned", "symbol date n_count:i n_tone:6", "SELECT symbol, date, n_count, n_tone FROM news_aligned")
def _(t):
    return news.align_news(t.bars, t.news).selectExpr(
        "symbol", "date", "news_count_aligned AS n_count", "news_tone_aligned AS n_tone")


@query("news_price_divergence", _cols(["news_price_divergence"]), "SELECT symbol, date, news_price_divergence FROM news_feature_rows")
def _(t):
    return news.news_features(price.daily_returns(t.bars), t.news)


NEWS_COLS = [f"news_count_{n}d" for n in (1, 3, 7, 14)] + [f"news_sentiment_{n}d" for n in (3, 7, 14)]


@query("news_rolling", _cols(NEWS_COLS), f"SELECT symbol, date, {', '.join(NEWS_COLS)} FROM news_feature_rows")
def _(t):
    return news.news_features(price.daily_returns(t.bars), t.news)


@query("target_open_to_open", _cols(["next_day_return"]),
       f"SELECT symbol, date, {div(lead('open', 2) + ' - ' + lead('open', 1), lead('open', 1))} AS next_day_return FROM bars")
def _(t):
    return news.target_open_to_open(t.bars)


@query("target_close_to_close", "symbol date target_return_1d:6 target_direction:i",
       f"""SELECT *, CASE WHEN target_return_1d > 0 THEN 1 WHEN target_return_1d < 0 THEN -1 WHEN target_return_1d = 0 THEN 0 END AS target_direction
       FROM (SELECT symbol, date, {lead('close', 1)} / close - 1 AS target_return_1d FROM bars) x""")
def _(t):
    return news.target_close_to_close(t.bars)


@query("adx_trend_strength", _cols(["adx"]), "SELECT symbol, date, adx FROM adx_rows")
def _(t):
    return regimes.adx(t.bars)


@query("forward_metrics", "symbol date future_vol:6 future_drawdown:6 future_adx:6 amihud_1e6:6",
       "SELECT *, future_amihud * 1e6 AS amihud_1e6 FROM fwd_rows")
def _(t):
    return regimes.forward_metrics(t.bars).withColumn("amihud_1e6", F.col("future_amihud") * 1e6)


@query("rolling_vol_threshold", "symbol date vol_threshold:6", "SELECT symbol, date, vol_threshold FROM label_thr")
def _(t):
    return regimes.rolling_threshold(regimes.forward_metrics(t.bars), {"vol_threshold": ("future_vol", 0.75)})


@query("regime_labels", "symbol date regime_vol:i regime_trend:i regime_liq:i", "SELECT * FROM label_rows")
def _(t):
    return regimes.label_regimes(t.bars)


@query("safety_lattice", "symbol date lattice_state:i state_name", "SELECT * FROM lattice_rows")
def _(t):
    return regimes.lattice(regimes.label_regimes(t.bars))


@query("state_exposure", "symbol date state_name exposure:6",
       "SELECT symbol, date, state_name, CASE WHEN lattice_state = 0 THEN 0e0 ELSE 1e0 END AS exposure FROM lattice_rows")
def _(t):
    return regimes.exposure(regimes.lattice(regimes.label_regimes(t.bars)))


V["component_rows"] = f"SELECT symbol, date, close, {roll('avg', 'close', 50)} AS ma_50, {raw_rsi_sql(14)} AS rsi_14 FROM px_tr"
V["component_signal_rows"] = """SELECT *, CASE WHEN close > ma_50 THEN 1e0 ELSE -1e0 END AS momentum_signal,
  CASE WHEN rsi_14 < 30 THEN 5e-1 WHEN rsi_14 > 70 THEN -5e-1 ELSE 0e0 END AS reversal_signal FROM component_rows"""


@query("component_signals", "symbol date momentum_signal:2 reversal_signal:2", "SELECT * FROM component_signal_rows")
def _(t):
    return regimes.component_signals(t.bars)


# The probability columns of the decision query are the percent ranks a bar's metrics have within the symbol.
V["decide_rows"] = """SELECT *, CASE WHEN lattice_state = 0 THEN 'EXIT_TO_CASH'
    WHEN coalesce(lag(CASE WHEN lattice_state = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date), 0) = 0 THEN 'ENTER_LONG'
    ELSE 'HOLD' END AS action,
  (abs(p_vol - 5e-1) * 2 + abs(p_range - 5e-1) * 2 + abs(p_close - 5e-1) * 2) / 3 AS confidence
  FROM (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY volume) AS p_vol,
               percent_rank() OVER (PARTITION BY symbol ORDER BY high - low) AS p_range,
               percent_rank() OVER (PARTITION BY symbol ORDER BY close) AS p_close FROM lattice_rows) x"""


def decisions(t):
    labelled = regimes.lattice(regimes.label_regimes(t.bars))
    ranked = labelled.selectExpr("*", *[
        f"percent_rank() OVER (PARTITION BY symbol ORDER BY {x}) AS {n}"
        for n, x in (("p_vol", "volume"), ("p_range", "high - low"), ("p_close", "close"))])
    return regimes.decide(ranked, ["p_vol", "p_range", "p_close"])


@query("trade_decisions", "symbol date state_name action confidence:6", "SELECT * FROM decide_rows")
def _(t):
    return decisions(t)


@query("vol_gate_positions", "symbol date ret:6 position:i regime", "SELECT symbol, date, ret, position, regime FROM strategy_daily")
def _(t):
    return regimes.vol_gate(t.bars)


@query("position_sizes", "symbol date state_name position_size:i",
       """SELECT symbol, date, state_name, CAST(trunc(100 * least(1e0, confidence / 7e-1) *
       CASE state_name WHEN 'HOSTILE' THEN 5e-1 WHEN 'FAVORABLE' THEN 1e0 ELSE 75e-2 END) AS BIGINT) AS position_size FROM decide_rows""")
def _(t):
    return regimes.position_size(decisions(t))


@query("info_drift_label", "symbol date regime_info:i",
       f"""SELECT symbol, date, CASE WHEN sign({change('close', 5)}) = sign({lead('close', 5)} / close - 1) THEN 1 ELSE 0 END AS regime_info FROM bars""")
def _(t):
    return regimes.info_label(t.bars)


def _rho(a, b):
    return f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"


@query("label_orthogonality", "symbol label_a label_b rho:6 max_abs_rho:6",
       f"""WITH r AS (SELECT symbol, {_rho('regime_vol', 'regime_trend')} AS vt, {_rho('regime_vol', 'regime_liq')} AS vl,
       {_rho('regime_trend', 'regime_liq')} AS tl FROM label_rows GROUP BY symbol)
       SELECT symbol, 'regime_vol' AS label_a, 'regime_trend' AS label_b, vt AS rho, greatest(abs(vt), abs(vl), abs(tl)) AS max_abs_rho FROM r
       UNION ALL SELECT symbol, 'regime_vol', 'regime_liq', vl, greatest(abs(vt), abs(vl), abs(tl)) FROM r
       UNION ALL SELECT symbol, 'regime_trend', 'regime_liq', tl, greatest(abs(vt), abs(vl), abs(tl)) FROM r""")
def _(t):
    return regimes.orthogonality(regimes.label_regimes(t.bars), ["regime_vol", "regime_trend", "regime_liq"])


@query("label_crosstab", "symbol regime_vol:i n_0:i n_1:i share_0:6 share_1:6",
       """SELECT symbol, regime_vol, n_0, n_1, n_0 * 1e0 / (n_0 + n_1) AS share_0, n_1 * 1e0 / (n_0 + n_1) AS share_1 FROM (
       SELECT symbol, regime_vol, count(*) FILTER (regime_trend = 0) AS n_0, count(*) FILTER (regime_trend = 1) AS n_1
       FROM label_rows GROUP BY 1, 2) c""")
def _(t):
    return regimes.label_crosstab(regimes.label_regimes(t.bars), "regime_vol", "regime_trend", [0, 1])
