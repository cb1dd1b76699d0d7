"""Source, quality, alignment, telemetry, reconciliation and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import align, market, news as news_ops, persistence, portfolio, price, quality, reconcile, regimes, stability, telemetry
from barloom.operators.backtest import equity
from barloom.operators.regimes import vol_gate
from barloom.operators.windows import check_no_leakage, time_series_folds, time_split, windows_calendar, windows_rows
from barloom.sources import bars as bar_sources, logs, news as news_sources, options as option_sources
from workloads.oracle import ORACLE_VIEWS as V
from workloads.registry import query
from workloads.sqlkit import RUN, W, change, div, frame, lag, roll, sdiv

# ---- sources ----

RAW = """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS open, l_extendedprice / l_quantity * 101e-2 AS high,
  l_extendedprice / l_quantity * 99e-2 AS low, p_retailprice AS close, l_quantity AS volume, l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("bars_first_per_day", "symbol date open:9 high:9 low:9 close:6 volume:i",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, open, volume) AS rn
       FROM ({RAW}) r) x WHERE rn = 1""")
def _(t):
    lines, parts = t.table("lineitem"), t.table("part")
    raw = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).selectExpr(
        "p_brand AS Symbol", "CAST(l_shipdate AS DATE) AS Date", "l_extendedprice / l_quantity AS Open",
        "l_extendedprice / l_quantity * 1.01D AS High", "l_extendedprice / l_quantity * 0.99D AS Low", "p_retailprice AS Close",
        "l_quantity AS Volume", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return bar_sources.normalize_bars(raw, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("bars_many_symbols", "symbol n_bars:i first_date last_date total_volume:i",
       "SELECT symbol, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date, sum(volume) AS total_volume FROM bars GROUP BY symbol")
def _(t):
    from pyspark.sql import functions as F

    return t.bars.groupBy("symbol").agg(F.expr("count(*) AS n_bars"), F.expr("min(date) AS first_date"), F.expr("max(date) AS last_date"),
                                        F.expr("sum(volume) AS total_volume"))


@query("benchmark_scan", "date close:6",
       "SELECT date, close FROM index_bars WHERE date >= (SELECT max(date) - INTERVAL 60 MONTH FROM index_bars)")
def _(t):
    return bar_sources.benchmark(t.index_bars)


@query("news_normalized", "symbol ts headline_md5 source feed",
       """SELECT symbol, ts, md5(headline) AS headline_md5, source, 'epoch' AS feed FROM news
       UNION ALL SELECT symbol, ts, md5(headline), source, 'iso' FROM news""")
def _(t):
    epoch = t.news.selectExpr("symbol", "to_json(array(named_struct('datetime', unix_seconds(ts), 'headline', headline, 'source', source, 'url', CAST(doc_id AS STRING)))) AS payload")
    iso = t.news.selectExpr("symbol", "to_json(array(named_struct('publishedAt', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'title', headline, 'source', named_struct('name', source)))) AS payload")
    out = news_sources.normalize_news(epoch, "epoch").selectExpr("*", "'epoch' AS feed").unionByName(
        news_sources.normalize_news(iso, "iso").selectExpr("*", "'iso' AS feed"))
    return out.selectExpr("*", "md5(headline) AS headline_md5")


@query("news_combined", "symbol ts headline_md5 source",
       """SELECT symbol, ts, md5(headline) AS headline_md5, source FROM (
       SELECT *, row_number() OVER (PARTITION BY symbol, headline, ts ORDER BY pr, source) AS rn FROM (
         SELECT symbol, ts, headline, source, 1 AS pr FROM news WHERE lang = 'en'
         UNION ALL SELECT symbol, ts, headline, source, 2 FROM news) u) x WHERE rn = 1""")
def _(t):
    rows = t.news.select("symbol", "ts", "headline", "source", "lang")
    out = news_sources.combine_news(rows.where("lang = 'en'").drop("lang"), rows.drop("lang"))
    return out.selectExpr("*", "md5(headline) AS headline_md5")


@query("trade_log_range", "order_id timestamp symbol action order_status",
       "SELECT * FROM trades WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp <= TIMESTAMP '1997-06-30'")
def _(t):
    return logs.between(t.trades, "1996-01-01 00:00:00", "1997-06-30 00:00:00")


AUDIT = "SELECT event_id AS decision_id, ts AS timestamp, signal, symbol AS signal_source, confidence FROM signals"


def audit(t):
    return t.signals.selectExpr("event_id AS decision_id", "ts AS timestamp", "signal", "symbol AS signal_source", "confidence")


@query("audit_recent", "decision_id timestamp signal", f"SELECT * FROM ({AUDIT}) a ORDER BY timestamp DESC, decision_id DESC LIMIT 20")
def _(t):
    return logs.audit_recent(audit(t))


@query("audit_by_id", "decision_id timestamp signal confidence:6", f"SELECT * FROM ({AUDIT}) a WHERE decision_id = 77")
def _(t):
    return logs.audit_by_id(audit(t), "77")


@query("option_chain_typed", "underlying expiration strike:2 option_type bid:6 ask:6 last:6 volume:i open_interest:i iv:6",
       "SELECT *  REPLACE (coalesce(volume, 0) AS volume, coalesce(open_interest, 0) AS open_interest) FROM option_quotes")
def _(t):
    return option_sources.normalize_chain(t.option_quotes)


# ---- quality ----

CHECKED = ["return_1d", "return_50d", "volatility_60d", "ma_200", "vol_ret_corr_20"]


@query("required_column_nulls", "column_name null_count:i n_rows:i",
       f"""WITH f AS (SELECT {change('close', 1)} AS return_1d, {change('close', 50)} AS return_50d, {roll('stddev_samp', 'r1', 60)} AS volatility_60d,
       {roll('avg', 'close', 200)} AS ma_200, CASE WHEN count(v) OVER {frame(20)} = 20 THEN 1 END AS vol_ret_corr_20
       FROM (SELECT *, CASE WHEN r1 IS NOT NULL THEN volume END AS v FROM px_ret) p)
       """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n_rows FROM f" for c in CHECKED))
def _(t):
    return quality.validate(price.price_features(t.bars), CHECKED)


@query("safe_ratio", "l_orderkey l_partkey l_linenumber ratio:6",
       "SELECT l_orderkey, l_partkey, l_linenumber, coalesce(l_quantity / nullif(l_tax, 0), -1e0) AS ratio FROM lineitem")
def _(t):
    return quality.with_ratio(t.table("lineitem"), "l_quantity", "l_tax", "ratio", -1.0)


@query("point_in_time", "symbol date close:6", "SELECT symbol, date, close FROM bars WHERE date <= DATE '1996-06-30'")
def _(t):
    return quality.as_of(t.bars, "1996-06-30")


FINAL = ["return_1d", "volatility_20d", "ma_50_ratio"]
V["final_rows"] = f"""SELECT symbol, date, coalesce(r1, 0e0) AS return_1d, coalesce({roll('stddev_samp', 'r1', 20)}, 0e0) AS volatility_20d,
  {sdiv('close', roll('avg', 'close', 50))} AS ma_50_ratio, (lead(open, 2) OVER {W} - lead(open, 1) OVER {W}) / lead(open, 1) OVER {W} AS next_day_return FROM px_ret"""


@query("features_final", "symbol date return_1d:6 volatility_20d:6 ma_50_ratio:6 next_day_return:6", "SELECT * FROM final_rows WHERE next_day_return IS NOT NULL")
def _(t):
    return quality.finalize_features(news_ops.target_open_to_open(price.price_features(t.bars)))


@query("features_selected", "feature n_values:i n_zero:i", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_values, count(*) FILTER (abs({c}) < 1e-12) AS n_zero FROM final_rows WHERE next_day_return IS NOT NULL" for c in FINAL))
def _(t):
    df = quality.finalize_features(news_ops.target_open_to_open(price.price_features(t.bars))).select("symbol", "date", "close", *FINAL, "next_day_return")
    values = ", ".join(f"struct('{c}' AS feature, {c} AS value)" for c in quality.feature_columns(df))
    return df.selectExpr(f"inline(array({values}))").groupBy("feature").agg(F.expr("count(value) AS n_values"), F.expr("count_if(abs(value) < 1e-12) AS n_zero"))


@query("directional_rows", "symbol date target_direction:i",
       "SELECT symbol, date, CASE WHEN nxt > close THEN 1 ELSE -1 END AS target_direction FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM bars) x WHERE nxt <> close")
def _(t):
    return quality.drop_neutral(news_ops.target_close_to_close(t.bars))


@query("unadjusted_splits", "symbol date open_return:6",
       f"""SELECT * FROM (SELECT symbol, date, open / lag(open) OVER {W} - 1 AS open_return FROM (
       SELECT symbol, date, CASE WHEN date >= DATE '1999-01-04' THEN open / 4 ELSE open END AS open FROM bars) b) x WHERE open_return < -5e-1""")
def _(t):
    # A four-for-one split on one day that was not adjusted for.
    raw = t.bars.selectExpr("symbol", "date", "IF(date >= DATE '1999-01-04', open / 4, open) AS open")
    return quality.flag_unadjusted_splits(raw)


IMPORTANT = ["return_1d", "return_5d", "high_low_ratio", "close_open_ratio", "momentum_10d", "volatility_20d"]
V["imp_rows"] = f"""SELECT r1 AS return_1d, {change('close', 5)} AS return_5d, high / low AS high_low_ratio, close / open AS close_open_ratio,
  {change('close', 10)} AS momentum_10d, {roll('stddev_samp', 'r1', 20)} AS volatility_20d,
  (lead(open, 2) OVER {W} - lead(open, 1) OVER {W}) / lead(open, 1) OVER {W} AS y FROM px_ret"""


@query("leak_suspects", "feature importance:6",
       "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS importance FROM imp_rows" for c in IMPORTANT)
       + ") z WHERE regexp_matches(feature, 'close|high|low|return_1d|momentum_1')")
def _(t):
    df = news_ops.target_open_to_open(price.price_features(t.bars))
    return quality.leak_suspects(quality.feature_importance(df, IMPORTANT))


# ---- alignment and windows ----


@query("inner_alignment", "symbol date close:6 signal:i position:i", "SELECT b.symbol, b.date, b.close, p.signal, s.position FROM bars b JOIN preds p USING (symbol, date) JOIN strategy_daily s USING (symbol, date)")
def _(t):
    gate = vol_gate(t.bars).select("symbol", "date", "position")
    return align.align([t.bars, t.preds.select("symbol", "date", "signal"), gate])


@query("left_alignment_filled", "symbol date close:6 regime position:i",
       "SELECT b.symbol, b.date, b.close, coalesce(s.regime, 'UNKNOWN') AS regime, coalesce(s.position, 1) AS position FROM bars b LEFT JOIN strategy_daily s USING (symbol, date)")
def _(t):
    return align.align_left(t.bars, vol_gate(t.bars), {"regime": "UNKNOWN", "position": 1})


@query("feature_union", "symbol date return_1d:6 news_count_1d:i",
       "SELECT symbol, date, coalesce(r1, 0e0) AS return_1d, 0 AS news_count_1d FROM px_ret UNION ALL SELECT symbol, date, 0e0, news_count FROM news_day")
def _(t):
    counts = news_ops.daily_news(t.news).selectExpr("symbol", "date", "CAST(news_count AS DOUBLE) AS news_count_1d")
    return align.union_features([price.daily_returns(t.bars).select("symbol", "date", "return_1d"), counts])


V["wf_span"] = "SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol"
V["wf_grid"] = """SELECT symbol, first_date, last_date, unnest(range(1, 1 + CAST(greatest(floor((date_diff('day', first_date, last_date) - 252) / 21e0), 0) AS BIGINT))) AS window_id FROM wf_span"""
V["wf_all"] = """SELECT symbol, window_id, first_date, CAST(first_date + CAST((window_id - 1) * 21 AS INTEGER) AS DATE) AS train_start,
  CAST(first_date + CAST(252 + (window_id - 1) * 21 AS INTEGER) AS DATE) AS test_start, CAST(first_date + CAST(252 + window_id * 21 AS INTEGER) AS DATE) AS test_end FROM wf_grid"""
V["wf_windows"] = """SELECT w.symbol, w.window_id, train_start, test_start, test_end, count(*) FILTER (b.date < test_start) AS train_rows, count(*) FILTER (b.date >= test_start) AS test_rows
  FROM wf_all w JOIN bars b ON b.symbol = w.symbol AND b.date >= w.train_start AND b.date < w.test_end GROUP BY ALL
  HAVING count(*) FILTER (b.date < test_start) >= 50 AND count(*) FILTER (b.date >= test_start) > 0"""
V["wf_rows"] = """SELECT b.symbol, b.date, w.window_id, CASE WHEN b.date < test_start THEN 'train' ELSE 'test' END AS role
  FROM wf_windows w JOIN bars b ON b.symbol = w.symbol AND b.date >= w.train_start AND b.date < w.test_end"""


@query("walk_forward_windows", "symbol window_id:i train_start test_start test_end train_rows:i test_rows:i", "SELECT * FROM wf_windows")
def _(t):
    return windows_calendar(t.bars)


@query("walk_forward_rows", "symbol window_id:i role n_rows:i first_date last_date",
       "SELECT symbol, window_id, role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM wf_rows GROUP BY 1, 2, 3")
def _(t):
    from pyspark.sql import functions as F

    rows = align.assign_windows(t.bars, windows_calendar(t.bars), 21, 252)
    return rows.groupBy("symbol", "window_id", "role").agg(F.expr("count(*) AS n_rows"), F.expr("min(date) AS first_date"), F.expr("max(date) AS last_date"))


V["rn_rows"] = f"SELECT symbol, date, row_number() OVER {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars"


def row_windows_sql(train: int, step: int, rolling: bool) -> str:
    lo = f"{train} + w * {step}"
    start = f"w * {step}" if rolling else "0"
    return f"""SELECT symbol, w AS window_id, CASE WHEN rn < {lo} THEN 'train' ELSE 'test' END AS role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
    FROM (SELECT *, unnest(range(0, CAST(ceil((n - {train}) / {step}e0) AS BIGINT))) AS w FROM rn_rows WHERE n > {train}) x
    WHERE rn >= {start} AND rn < {lo} + {step} GROUP BY 1, 2, 3"""


def _window_counts(df, key="window_id"):
    from pyspark.sql import functions as F

    return df.groupBy("symbol", key, "role").agg(F.expr("count(*) AS n_rows"), F.expr("min(date) AS first_date"), F.expr("max(date) AS last_date"))


@query("row_windows_rolling", "symbol window_id:i role n_rows:i first_date last_date", row_windows_sql(500, 60, True))
def _(t):
    return _window_counts(windows_rows(t.bars, 500, 60, "rolling"))


@query("row_windows_expanding", "symbol window_id:i role n_rows:i first_date last_date", row_windows_sql(500, 120, False))
def _(t):
    return _window_counts(windows_rows(t.bars, 500, 120, "expanding"))


@query("time_series_folds", "symbol fold:i role n_rows:i first_date last_date",
       """SELECT symbol, fold, CASE WHEN rn < first_n + fold * sz THEN 'train' ELSE 'test' END AS role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
       FROM (SELECT *, n // 6 AS sz, n - (n // 6) * 5 AS first_n, unnest(range(0, 5)) AS fold FROM rn_rows) x WHERE rn < first_n + (fold + 1) * sz GROUP BY 1, 2, 3""")
def _(t):
    return _window_counts(time_series_folds(t.bars), "fold")


@query("time_ordered_split", "symbol split n_rows:i last_date",
       "SELECT symbol, CASE WHEN rn + 1 <= floor(n * 8e-1) THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, max(date) AS last_date FROM rn_rows GROUP BY 1, 2")
def _(t):
    from pyspark.sql import functions as F

    return time_split(t.bars, 0.8).groupBy("symbol", "split").agg(F.expr("count(*) AS n_rows"), F.expr("max(date) AS last_date"))


@query("leakage_violations", "symbol max_train min_test",
       """SELECT a.symbol, max_train, min_test FROM (SELECT symbol, max(date) AS max_train FROM bars WHERE volume <= 50 GROUP BY 1) a
       JOIN (SELECT symbol, min(date) AS min_test FROM bars WHERE volume > 50 GROUP BY 1) b USING (symbol) WHERE max_train >= min_test""")
def _(t):
    return check_no_leakage(t.bars.where("volume <= 50"), t.bars.where("volume > 50"), ["symbol"])


# ---- telemetry ----

V["slip"] = """SELECT *, CASE WHEN expected_price > 0 THEN (CASE WHEN side = 'sell' THEN -1 ELSE 1 END) * (actual_fill_price - expected_price) / expected_price * 10000 ELSE 0e0 END AS slippage_bps,
  actual_fill_price * qty AS notional, (epoch_us(fill_ts) - epoch_us(submit_ts)) / 1e3 AS time_delay_ms FROM fills"""
STAT = """avg(slippage_bps) AS mean_bps, stddev_pop(slippage_bps) AS std_bps, min(slippage_bps) AS min_bps, max(slippage_bps) AS max_bps,
  count(*) AS fills, sum(notional) AS total_notional, avg(CASE WHEN partial_fill THEN 1e0 ELSE 0e0 END) AS partial_fill_rate"""
V["slip_stats"] = f"SELECT symbol, {STAT} FROM slip GROUP BY symbol UNION ALL SELECT 'ALL', {STAT} FROM slip"


@query("fill_slippage", "order_id symbol side slippage_bps:6 notional:4 time_delay_ms:3", "SELECT * FROM slip")
def _(t):
    return telemetry.slippage(t.fills)


@query("slippage_stats", "symbol mean_bps:6 std_bps:6 min_bps:6 max_bps:6 fills:i total_notional:2 partial_fill_rate:6", "SELECT * FROM slip_stats")
def _(t):
    return telemetry.slippage_stats(telemetry.slippage(t.fills))


@query("slippage_bounds", "symbol fills:i mean_bps:6 within_bounds bounds_state", "SELECT *, CASE WHEN within_bounds THEN 'within' WHEN NOT within_bounds THEN 'outside' ELSE 'too_few' END AS bounds_state FROM (SELECT symbol, fills, mean_bps, CASE WHEN fills >= 5 THEN mean_bps BETWEEN -1e0 AND 1e0 END AS within_bounds FROM slip_stats) x")
def _(t):
    return telemetry.slippage_bounds(telemetry.slippage_stats(telemetry.slippage(t.fills)), 0.0, 1.0)


@query("daily_slippage", "day fills:i avg_slippage_bps:6 max_slippage_bps:6 breach",
       "SELECT CAST(fill_ts AS DATE) AS day, count(*) AS fills, avg(slippage_bps) AS avg_slippage_bps, greatest(max(slippage_bps), 0e0) AS max_slippage_bps, max(slippage_bps) > 9 AS breach FROM slip GROUP BY 1")
def _(t):
    return telemetry.daily_slippage(telemetry.slippage(t.fills), 9.0)


V["gate_actions"] = f"""SELECT symbol, date, open, close, regime, CASE WHEN position = 1 AND prev = 0 THEN 'ENTER_LONG' WHEN position = 0 AND prev = 1 THEN 'EXIT_TO_CASH' ELSE 'HOLD' END AS action
  FROM (SELECT *, coalesce(lag(position) OVER {W}, 0) AS prev FROM strategy_daily) g"""
V["dec_match"] = f"""SELECT *, expected_action = actual_action AS is_aligned, expected_regime = actual_regime AS regime_aligned,
  CASE WHEN expected_price > 0 THEN (CASE WHEN actual_action = 'ENTER_LONG' THEN 1 ELSE -1 END) * (actual_price - expected_price) / expected_price * 10000 ELSE 0e0 END AS slippage_bps
  FROM (SELECT symbol, date, action AS expected_action, regime AS expected_regime, close AS expected_price,
               lag(action) OVER {W} AS actual_action, lag(regime) OVER {W} AS actual_regime, open AS actual_price FROM gate_actions) d WHERE actual_action IS NOT NULL"""


def both_decisions(t):
    """Expected decisions of the gate, and what was done: the same one bar late at the open."""
    w = "OVER (PARTITION BY symbol ORDER BY date)"
    gate = vol_gate(t.bars).selectExpr("*", f"coalesce(lag(position) {w}, 0) AS prev").selectExpr(
        "symbol", "date", "open", "close", "regime", "CAST(date AS TIMESTAMP) AS ts",
        "CASE WHEN position = 1 AND prev = 0 THEN 'ENTER_LONG' WHEN position = 0 AND prev = 1 THEN 'EXIT_TO_CASH' ELSE 'HOLD' END AS action")
    expected = gate.selectExpr("symbol", "date", "ts", "action", "regime", "close AS price")
    actual = gate.selectExpr("symbol", "date", "ts", f"lag(action) {w} AS action", f"lag(regime) {w} AS regime", "open AS price")
    return expected, actual.where("action IS NOT NULL")


@query("decision_match", "symbol date expected_action actual_action is_aligned regime_aligned slippage_bps:6", "SELECT * FROM dec_match")
def _(t):
    return reconcile.match_decisions(*both_decisions(t))


@query("decision_reconciliation",
       "date total_decisions:i aligned_decisions:i regime_misclassifications:i avg_slippage_bps:6 max_slippage_bps:6 missed_exits:i missed_entries:i",
       """SELECT date, count(*) AS total_decisions, count(*) FILTER (is_aligned) AS aligned_decisions, count(*) FILTER (NOT regime_aligned) AS regime_misclassifications,
       avg(slippage_bps) AS avg_slippage_bps, max(slippage_bps) AS max_slippage_bps,
       count(*) FILTER (expected_action = 'EXIT_TO_CASH' AND actual_action <> 'EXIT_TO_CASH') AS missed_exits,
       count(*) FILTER (expected_action = 'ENTER_LONG' AND actual_action <> 'ENTER_LONG') AS missed_entries FROM dec_match GROUP BY date""")
def _(t):
    return reconcile.reconciliation_report(reconcile.match_decisions(*both_decisions(t)))


@query("decision_discrepancies", "symbol date expected actual issue",
       """SELECT symbol, date, expected_action AS expected, actual_action AS actual, concat_ws('; ',
       CASE WHEN NOT is_aligned THEN concat('Action mismatch: ', expected_action, ' → ', actual_action) END,
       CASE WHEN NOT regime_aligned THEN concat('Regime mismatch: ', expected_regime, ' → ', actual_regime) END,
       CASE WHEN abs(slippage_bps) > 20 THEN concat('High slippage: ', printf('%.1f', slippage_bps), ' bps') END) AS issue
       FROM dec_match WHERE NOT is_aligned OR NOT regime_aligned OR abs(slippage_bps) > 20""")
def _(t):
    return reconcile.discrepancies(reconcile.match_decisions(*both_decisions(t)))


@query("shadow_parity", "symbol compared:i divergences:i alignment_rate:6",
       """SELECT symbol, count(*) AS compared, count(*) FILTER (NOT is_aligned) AS divergences, avg(CASE WHEN is_aligned THEN 1e0 ELSE 0e0 END) AS alignment_rate
       FROM dec_match GROUP BY symbol""")
def _(t):
    expected, actual = both_decisions(t)
    return reconcile.shadow_parity(actual, expected)


@query("fill_reconciliation", "client_order_id issue expected:10 actual:10",
       """WITH j AS (SELECT f.*, o.filled_qty AS q, o.avg_price AS p, o.client_order_id AS known FROM broker_fills f LEFT JOIN order_ledger o USING (client_order_id))
       SELECT client_order_id, 'unknown_fill' AS issue, NULL::DOUBLE AS expected, NULL::DOUBLE AS actual FROM j WHERE known IS NULL
       UNION ALL SELECT client_order_id, 'quantity_mismatch', q, filled_qty FROM j WHERE abs(filled_qty - q) > 1e-2
       UNION ALL SELECT client_order_id, 'price_mismatch', p, avg_price FROM j WHERE abs(avg_price - p) > 1e-2""")
def _(t):
    return reconcile.reconcile_fills(t.order_ledger, t.broker_fills)


V["week_pnl"] = """SELECT symbol, date, CAST(date_trunc('week', date) AS DATE) AS week, ret * position AS daily_return, 1e5 * seq AS equity FROM gate_curves"""
V["week_actual"] = """SELECT symbol, week, (max_by(equity, date) / min_by(equity, date) - 1) * 100 AS actual_return,
  CASE WHEN count(*) > 1 THEN coalesce(avg(daily_return) / nullif(stddev_pop(daily_return), 0) * sqrt(252e0), 0e0) ELSE 0e0 END AS actual_sharpe, max(dd) AS actual_drawdown
  FROM (SELECT *, (1 - equity / max(equity) OVER (PARTITION BY symbol, week ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 100 AS dd FROM week_pnl) x GROUP BY 1, 2"""
V["week_rows"] = """SELECT a.*, coalesce(actual_turnover, 0) AS turnover, coalesce(actual_slippage_mean, 0e0) AS slip FROM week_actual a
  LEFT JOIN (SELECT symbol, CAST(date_trunc('week', timestamp) AS DATE) AS week, count(*) FILTER (order_status <> 'NO_ACTION') AS actual_turnover FROM trades GROUP BY 1, 2) t USING (symbol, week)
  LEFT JOIN (SELECT symbol, CAST(date_trunc('week', fill_ts) AS DATE) AS week, avg(slippage_bps) AS actual_slippage_mean FROM slip GROUP BY 1, 2) f USING (symbol, week)"""


@query("weekly_reconciliation",
       "symbol week actual_return:6 bounded_sharpe:5 actual_drawdown:6 actual_turnover:i actual_slippage_mean:6 return_divergence:6 turnover_divergence:6 status",
       """SELECT *, turnover AS actual_turnover, greatest(-1e4, least(1e4, actual_sharpe)) AS bounded_sharpe, slip AS actual_slippage_mean, actual_return - 15e0 * 7 / 365 AS return_divergence, turnover - 2e0 AS turnover_divergence,
       CASE WHEN actual_drawdown - 20 > 10 THEN 'FAIL' WHEN abs(actual_return - 15e0 * 7 / 365) > 10 OR actual_sharpe - 1 < -5e-1 OR abs(turnover - 2e0) > 5 THEN 'WARN' ELSE 'PASS' END AS status FROM week_rows""")
def _(t):
    gate = vol_gate(t.bars).selectExpr("symbol", "date", "ret * position AS daily_return")
    out = reconcile.weekly_reconciliation(equity(gate, ret="daily_return", start=100_000.0), t.trades, telemetry.slippage(t.fills))
    # Two nearly equal returns in a week give a deviation of pure rounding noise, so the ratio is bounded for display.
    return out.selectExpr("*", "greatest(-10000D, least(10000D, actual_sharpe)) AS bounded_sharpe")


@query("audit_summary", "dimension value n:i",
       f"SELECT 'signal' AS dimension, signal AS value, count(*) AS n FROM ({AUDIT}) a GROUP BY 2 UNION ALL SELECT 'source', signal_source, count(*) FROM ({AUDIT}) a GROUP BY 2")
def _(t):
    return telemetry.audit_summary(audit(t))


V["order_ids"] = """SELECT *, concat(strftime(day, '%Y%m%d'), '_', symbol, '_', side, '_', substr(md5(concat(strftime(day, '%Y%m%d'), '_', symbol, '_', side, '_', signal_id)), 1, 8)) AS client_order_id
  FROM (SELECT *, CASE WHEN signal = 'EXIT_TO_CASH' THEN 'sell' ELSE 'buy' END AS side FROM signals) s"""


@query("client_order_ids", "event_id client_order_id config_hash", "SELECT *, md5(concat_ws('|', symbol, signal)) AS config_hash FROM order_ids")
def _(t):
    sided = t.signals.selectExpr("*", "IF(signal = 'EXIT_TO_CASH', 'sell', 'buy') AS side")
    return telemetry.config_hash(telemetry.order_id(sided), ["symbol", "signal"])


@query("order_size_check", "order_id qty:i pct_of_adv:6 allowed",
       """SELECT order_id, qty, qty / nullif(adv, 0) AS pct_of_adv, adv <= 0 OR qty / adv <= 25e-2 AS allowed
       FROM fills JOIN (SELECT symbol, avg(volume) AS adv FROM bars GROUP BY 1) a USING (symbol)""")
def _(t):
    from pyspark.sql import functions as F

    adv = t.bars.groupBy("symbol").agg(F.expr("avg(volume) AS adv"))
    return telemetry.adv_check(t.fills, adv, 0.25)


V["flat_runs"] = f"""SELECT symbol, run_id, min(date) AS entry_date, max(date) AS as_of, CASE WHEN position_regime = 'HOSTILE' THEN 'tbills' ELSE 'money_market' END AS vehicle
  FROM (SELECT *, sum(s) OVER {RUN} AS run_id, first_value(regime) OVER (PARTITION BY symbol) AS r0 FROM (
  SELECT *, CASE WHEN position = lag(position) OVER {W} THEN 0 ELSE 1 END AS s FROM strategy_daily) a) b, (SELECT 'x' AS position_regime) z WHERE position = 0 GROUP BY ALL"""
V["parked"] = f"""SELECT symbol, position_id, vehicle, 1e4 AS amount, entry_date, as_of, CASE vehicle WHEN 'tbills' THEN 45e-3 ELSE 5e-2 END AS apy, date_diff('day', entry_date, as_of) AS days_parked FROM (
  SELECT symbol, run_id AS position_id, min(date) AS entry_date, max(date) AS as_of, CASE WHEN run_id > 20 THEN 'tbills' ELSE 'money_market' END AS vehicle
  FROM (SELECT *, sum(s) OVER {RUN} AS run_id FROM (SELECT *, CASE WHEN position = lag(position) OVER {W} THEN 0 ELSE 1 END AS s FROM strategy_daily) a) b
  WHERE position = 0 GROUP BY 1, 2) p"""
del V["flat_runs"]


def parked(t):
    spells = telemetry.parked_spells(vol_gate(t.bars), "IF(run_id > 20, 'tbills', 'money_market')", 10_000.0)
    return telemetry.parking_yield(spells)


@query("parked_cash_yield", "symbol position_id:i vehicle days_parked:i accrued_yield:6 current_value:6",
       "SELECT *, amount * apy / 365 * days_parked AS accrued_yield, amount + amount * apy / 365 * days_parked AS current_value FROM parked")
def _(t):
    return parked(t)


@query("parked_cash_totals", "vehicle positions:i principal:2 accrued_yield:4 current_value:4",
       """SELECT vehicle, count(*) AS positions, sum(amount) AS principal, sum(amount * apy / 365 * days_parked) AS accrued_yield,
       sum(amount + amount * apy / 365 * days_parked) AS current_value FROM parked GROUP BY vehicle""")
def _(t):
    return telemetry.parking_totals(parked(t))


def bucket_sql(value: str, edges, by: str) -> str:
    parts = [f"SELECT {by}, {e!r}::DOUBLE AS le, count(*) FILTER ({value} <= {e!r}) AS n FROM slip GROUP BY {by}" for e in edges]
    parts.append(f"SELECT {by}, 'Infinity'::DOUBLE, count({value}) FROM slip GROUP BY {by}")
    return " UNION ALL ".join(parts)


@query("slippage_buckets", "symbol side le:2 n:i", bucket_sql("round(slippage_bps, 6)", telemetry.SLIPPAGE_EDGES, "symbol, side"))
def _(t):
    return telemetry.bucket_counts(telemetry.slippage(t.fills), "round(slippage_bps, 6)", telemetry.SLIPPAGE_EDGES, ["symbol", "side"])


@query("fill_latency_buckets", "symbol le:2 n:i", bucket_sql("(time_delay_ms / 1e3)", telemetry.FILL_LATENCY_EDGES, "symbol"))
def _(t):
    return telemetry.bucket_counts(telemetry.slippage(t.fills), "(time_delay_ms / 1000D)", telemetry.FILL_LATENCY_EDGES, ["symbol"])


@query("orders_per_day", "day order_status n:i", "SELECT CAST(timestamp AS DATE) AS day, order_status, count(*) AS n FROM trades GROUP BY 1, 2")
def _(t):
    return telemetry.orders_per_day(t.trades)


# ---- portfolio ----

V["alloc_in"] = f"""SELECT p.symbol, p.date, CASE p.signal WHEN 1 THEN 'LONG' WHEN 0 THEN 'HOLD' ELSE 'EXIT' END AS signal, confidence, v.volatility FROM preds p
  LEFT JOIN (SELECT symbol, date, {roll('stddev_samp', 'r1', 20)} * sqrt(252e0) AS volatility FROM px_ret) v USING (symbol, date)"""
V["alloc_raw"] = """SELECT *, coalesce(volatility, 2e-1) AS vol, CASE WHEN signal = 'LONG' AND confidence >= 4e-1 THEN
  (CASE WHEN coalesce(volatility, 2e-1) > 0 THEN 15e-2 / coalesce(volatility, 2e-1) ELSE 1e0 END) * confidence ELSE 0e0 END AS raw FROM alloc_in"""
V["alloc_cap"] = """SELECT *, least(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY date), 0), 0e0), 5e-1) AS capped FROM alloc_raw"""
V["alloc"] = """SELECT *, capped / greatest(sum(capped) OVER (PARTITION BY date), 1e0) AS weight FROM alloc_cap"""


def allocation(t):
    vol = price.price_features(t.bars).selectExpr("symbol", "date", "realized_vol_20d AS volatility")
    signals = t.preds.selectExpr("symbol", "date", "CASE signal WHEN 1 THEN 'LONG' WHEN 0 THEN 'HOLD' ELSE 'EXIT' END AS signal", "confidence")
    return portfolio.allocate(signals.join(vol, ["symbol", "date"], "left"))


@query("capital_allocation", "symbol date signal weight:6 notional:4 reason_kind",
       """SELECT *, 95e3 * weight AS notional, CASE WHEN weight > 0 THEN 'Confidence' WHEN signal <> 'LONG' THEN concat('Signal is ', signal)
       WHEN confidence < 4e-1 THEN 'Confidence' ELSE 'Not allocated' END AS reason_kind FROM alloc""")
def _(t):
    return allocation(t).selectExpr("*", "IF(reason LIKE 'Confidence%', 'Confidence', reason) AS reason_kind")


@query("cash_reserve", "date total_allocated:4 cash_reserve:4 n_assets:i",
       "SELECT date, sum(95e3 * weight) AS total_allocated, 1e5 - sum(95e3 * weight) AS cash_reserve, count(*) FILTER (weight > 0) AS n_assets FROM alloc GROUP BY date")
def _(t):
    return portfolio.cash_reserve(allocation(t))


V["positions"] = """SELECT p.portfolio_id, symbol, date, CASE WHEN p.portfolio_id = 'core' THEN 2e4 * position ELSE 5e3 * (1 - position) END AS value
  FROM strategy_daily, (SELECT unnest(['core', 'satellite']) AS portfolio_id) p"""


def positions(t):
    gate = vol_gate(t.bars)
    held = gate.selectExpr("symbol", "date", "inline(array(struct('core' AS portfolio_id, 20000D * position AS value), struct('satellite' AS portfolio_id, 5000D * (1 - position) AS value)))")
    return held, gate.select("symbol", "date", "ret")


V["exp_agg"] = "SELECT portfolio_id, date, sum(abs(value)) / 1e3 AS tot, max(abs(value)) / 1e3 AS single, count(*) FILTER (abs(value) > 0) * 1e0 AS cnt FROM positions GROUP BY 1, 2"
V["exp_checks"] = """SELECT portfolio_id, date, 'total_exposure' AS limit_name, tot AS current_value, 150e0 AS limit_value FROM exp_agg
  UNION ALL SELECT portfolio_id, date, 'single_asset', single, 50e0 FROM exp_agg UNION ALL SELECT portfolio_id, date, 'position_count', cnt, 4e0 FROM exp_agg"""


@query("exposure_limits", "portfolio_id date limit_name current_value:4 limit_value:1 passed action_required",
       "SELECT *, current_value <= limit_value AS passed, CASE WHEN current_value <= limit_value THEN 'none' ELSE 'reduce' END AS action_required FROM exp_checks")
def _(t):
    return portfolio.exposure_checks(positions(t)[0], 100_000.0)


V["last_dates"] = "SELECT DISTINCT date FROM strategy_daily ORDER BY date DESC LIMIT 60"
V["corr_days"] = "SELECT symbol, date, ret FROM strategy_daily WHERE date IN (SELECT date FROM last_dates)"
V["corr_rows"] = """SELECT s.symbol AS symbol_a, z.symbol AS symbol_b, count(b.ret) FILTER (a.ret IS NOT NULL) AS n,
  CASE WHEN count(b.ret) FILTER (a.ret IS NOT NULL) > 1 THEN covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) FILTER (b.ret IS NOT NULL) * stddev_pop(b.ret) FILTER (a.ret IS NOT NULL), 0) END AS rho
  FROM (SELECT DISTINCT symbol FROM corr_days) s CROSS JOIN (SELECT DISTINCT symbol FROM corr_days) z
  LEFT JOIN corr_days a ON a.symbol = s.symbol LEFT JOIN corr_days b ON b.symbol = z.symbol AND b.date = a.date GROUP BY 1, 2"""


@query("correlation_matrix", "symbol_a symbol_b n:i rho:6", "SELECT * FROM corr_rows")
def _(t):
    return portfolio.correlation_matrix(vol_gate(t.bars))


@query("correlated_exposure", "portfolio_id date correlated_exposure_pct:4 passed",
       """SELECT portfolio_id, date, max(own + coalesce(shared, 0)) / 1e3 AS correlated_exposure_pct, max(own + coalesce(shared, 0)) / 1e3 <= 80 AS passed FROM (
       SELECT p.portfolio_id, p.date, p.symbol, abs(p.value) AS own, (SELECT sum(abs(q.value)) FROM positions q JOIN corr_rows c ON c.symbol_b = q.symbol
         WHERE q.portfolio_id = p.portfolio_id AND q.date = p.date AND c.symbol_a = p.symbol AND c.symbol_a <> c.symbol_b AND c.rho > 2e-1) AS shared FROM positions p) x GROUP BY 1, 2""")
def _(t):
    held, returns = positions(t)
    return portfolio.correlated_exposure(held, portfolio.correlation_matrix(returns, threshold=0.2), 100_000.0, 0.2)


V["port_eq"] = """SELECT portfolio_id, date, 1e5 + sum(pnl) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity
  FROM (SELECT portfolio_id, date, sum(value * ret) AS pnl FROM positions JOIN strategy_daily USING (symbol, date) GROUP BY 1, 2) x"""
V["port_dd"] = """SELECT *, abs(equity / max(equity) OVER (PARTITION BY portfolio_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * 100 AS dd FROM port_eq"""


@query("portfolio_state", "portfolio_id date total_exposure_pct:4 largest_position_pct:4 current_drawdown_pct:6 active_positions:i all_checks_passed failed",
       """SELECT portfolio_id, date, tot AS total_exposure_pct, single AS largest_position_pct, dd AS current_drawdown_pct, cnt AS active_positions,
       tot <= 150 AND single <= 50 AND cnt <= 4 AND dd <= 10 AS all_checks_passed,
       concat_ws(',', CASE WHEN dd > 10 THEN 'portfolio_drawdown' END, CASE WHEN cnt > 4 THEN 'position_count' END, CASE WHEN single > 50 THEN 'single_asset' END,
         CASE WHEN tot > 150 THEN 'total_exposure' END) AS failed FROM exp_agg JOIN port_dd USING (portfolio_id, date)""")
def _(t):
    held, returns = positions(t)
    return portfolio.portfolio_state(held, returns, 100_000.0).selectExpr("*", "array_join(failed_checks, ',') AS failed")


V["elig"] = f"""SELECT symbol, adv, spread, steady FROM (SELECT symbol, avg(volume * close) AS adv FROM bars GROUP BY 1) a
  LEFT JOIN (SELECT symbol, avg(abs(slippage_bps)) AS spread FROM slip GROUP BY 1) s USING (symbol)
  LEFT JOIN (SELECT symbol, CASE WHEN count(*) > 1 THEN avg(same) ELSE 0e0 END AS steady FROM (
    SELECT symbol, CASE WHEN regime = lag(regime) OVER {W} THEN 1e0 ELSE 0e0 END AS same FROM strategy_daily) x GROUP BY 1) r USING (symbol)"""
BLOCKED = "symbol = 'Brand#25'"


@query("asset_eligibility", "symbol eligible liquidity_score:6 regime_clarity_score:6 execution_score:6 complexity_score:2 regime_consistency:6 n_reasons:i",
       f"""SELECT symbol, NOT {BLOCKED} AND n = 0 AS eligible, CASE WHEN {BLOCKED} THEN 0e0 ELSE least(1e0, adv / 6e3) END AS liquidity_score,
       CASE WHEN {BLOCKED} THEN 0e0 WHEN steady > 0 THEN steady ELSE 7e-1 END AS regime_clarity_score,
       CASE WHEN {BLOCKED} THEN 0e0 WHEN spread > 0 THEN greatest(0e0, 1 - spread / 20) ELSE 7e-1 END AS execution_score,
       CASE WHEN {BLOCKED} THEN 0e0 WHEN symbol = 'Brand#2' THEN 3e-1 WHEN symbol IN ('Brand#1', 'Brand#3') THEN 1e0 ELSE 5e-1 END AS complexity_score,
       CASE WHEN {BLOCKED} THEN 0e0 ELSE steady END AS regime_consistency, CASE WHEN {BLOCKED} THEN 1 ELSE n END AS n_reasons FROM (
       SELECT *, (adv < 3e3 AND adv > 0)::INT + (spread > 10)::INT + (steady < 6e-1)::INT + (symbol NOT IN ('Brand#1', 'Brand#2', 'Brand#3'))::INT AS n FROM elig) e""")
def _(t):
    spreads = telemetry.slippage(t.fills).selectExpr("symbol", "abs(slippage_bps) AS spread_bps")
    out = portfolio.eligibility(t.bars, spreads, vol_gate(t.bars), {"Brand#1": False, "Brand#2": True, "Brand#3": False}, ("Brand#25",), min_adv=3000.0)
    return out.selectExpr("*", "size(rejection_reasons) AS n_reasons")
