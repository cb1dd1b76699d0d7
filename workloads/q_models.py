"""Specialist, ensemble and tree model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import LOOKBACK_WINDOWS, MA_WINDOWS
from barloom.operators import ensemble, leakage, market, moments, news, pooled, price, quality, regimes, specialists, trees
from barloom.operators.backtest import baselines, net_returns, pnl_metrics, signal_metrics  # noqa: F401
from barloom.operators.specialists import MA_RATIO, MOMENTUM, NEWS, RSI
from barloom.operators.windows import time_split, windows_calendar
from barloom.plans.stage import staged
from workloads.oracle import ORACLE_VIEWS as V
from workloads.q_backtest import SIG_COLS, PNL_COLS, net_sql, pnl_sql, signal_sql
from workloads.registry import query
from workloads.sqlkit import W, change, draw, lag, roll, sdiv

_returns = ", ".join(f"{change('close', n)} AS return_{n}d, ln(close / {lag('close', n)}) AS log_return_{n}d" for n in LOOKBACK_WINDOWS)
_momentum = ", ".join(f"{change('close', n)} AS momentum_{n}d" for n in (5, 10, 20))
_rsi = ", ".join(f"100 - 100 / (1 + {sdiv(roll('avg', 'gain', n), roll('avg', 'loss', n))}) AS rsi_{n}" for n in (14, 30))
_ma = ", ".join(f"{sdiv('close', roll('avg', 'close', n))} AS ma_{n}_ratio" for n in MA_WINDOWS)
V["model_feat"] = f"SELECT symbol, date, {_returns}, {_momentum}, {_rsi}, {_ma} FROM px_tr"
_fill = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in [*MOMENTUM, *RSI, *MA_RATIO, *NEWS])
V["model_rows"] = f"""SELECT symbol, date, {_fill}, p.actual_return, p.actual_direction,
  CASE WHEN row_number() OVER {W} <= floor(count(*) OVER (PARTITION BY symbol) * 7e-1) THEN 'train' ELSE 'test' END AS split
  FROM model_feat JOIN news_feature_rows USING (symbol, date) JOIN (SELECT symbol, date, actual_return, actual_direction FROM preds) p USING (symbol, date)"""


def rho_sql(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _rule_family(family, cuts, train: str = "model_train", by: str = "symbol") -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, {k} AS k, '{c}' AS name, coalesce(round(abs({rho_sql(c, 'actual_direction')}), 12), -1e0) AS r"
        + "".join(f", quantile_cont({c}, {q}) AS q{i}" for i, q in enumerate(cuts)) + f" FROM {train} GROUP BY {by}"
        for k, c in enumerate(family))


V["model_train"] = "SELECT * FROM model_rows WHERE split = 'train'"
V["model_test"] = "SELECT * FROM model_rows WHERE split = 'test'"
V["wfm_rows"] = """SELECT m.*, w.window_id, CASE WHEN m.date < w.test_start THEN 'train' ELSE 'test' END AS role FROM model_rows m
  JOIN wf_windows w ON m.symbol = w.symbol AND m.date >= w.train_start AND m.date < w.test_end"""
V["wfm_train"] = "SELECT * FROM wfm_rows WHERE role = 'train'"
V["wfm_test"] = "SELECT * FROM wfm_rows WHERE role = 'test'"

def _add_rule_fits(pre: str, train: str, by: str) -> None:
    for name, family, cuts in (("rule_mom", MOMENTUM, (0.6,)), ("rule_rsi", RSI, (0.2, 0.8)), ("rule_ma", MA_RATIO, ())):
        V[pre + name] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY r DESC, k) AS rk FROM ({_rule_family(family, cuts, train, by)}) f) g WHERE rk = 1"
    V[pre + "rule_fit"] = f"""SELECT {by}, m.name AS momentum_col, m.q0 AS momentum_threshold, r.name AS rsi_col, r.q0 AS rsi_oversold, r.q1 AS rsi_overbought, a.name AS ma_col
  FROM {pre}rule_mom m JOIN {pre}rule_rsi r USING ({by}) JOIN {pre}rule_ma a USING ({by})"""


_add_rule_fits("", "model_train", "symbol")
_add_rule_fits("wfm_", "wfm_train", "symbol, window_id")


def _pick_sql(name, family):
    return f"CASE {name} " + " ".join(f"WHEN '{c}' THEN {c}" for c in family) + " END"


def rule_scores(rows: str, fit: str, by: str, out: str | None = None) -> str:
    return f"""SELECT {out or by}, date, actual_return, actual_direction, 'rules' AS model, prob_up, 5e-1 AS confidence, CASE WHEN 5e-1 < 4e-1 THEN 0 WHEN prob_up > 5e-1 THEN 1 ELSE -1 END AS signal FROM (
  SELECT m.*, CASE WHEN (CASE WHEN {_pick_sql('momentum_col', MOMENTUM)} > momentum_threshold THEN 4e-1 ELSE 0e0 END)
   + ((CASE WHEN {_pick_sql('rsi_col', RSI)} < rsi_oversold THEN 3e-1 ELSE 0e0 END) + (CASE WHEN {_pick_sql('rsi_col', RSI)} > rsi_overbought THEN -3e-1 ELSE 0e0 END))
   + (CASE WHEN {_pick_sql('ma_col', MA_RATIO)} > 1 THEN 3e-1 ELSE 0e0 END) > 0 THEN 1e0 ELSE 0e0 END AS prob_up FROM {rows} m JOIN {fit} USING ({by})) x"""


V["rule_scores"] = rule_scores("model_test", "rule_fit", "symbol")
V["sent_fit"] = "SELECT symbol, " + ", ".join(f"coalesce({rho_sql(c, 'actual_direction')}, 0e0) AS w_{c}" for c in NEWS) + " FROM model_train GROUP BY symbol"
V["wfm_sent_fit"] = "SELECT symbol, window_id, " + ", ".join(f"coalesce({rho_sql(c, 'actual_direction')}, 0e0) AS w_{c}" for c in NEWS) + " FROM wfm_train GROUP BY symbol, window_id"
_sum = " + ".join(f"{c} * w_{c}" for c in NEWS)


def sent_scores(rows: str, fit: str, conf: str) -> str:
    return f"""SELECT *, 2 * abs(prob_up - 5e-1) AS confidence, CASE WHEN 2 * abs(prob_up - 5e-1) < {conf} THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal FROM (
  SELECT m.symbol, m.date, m.actual_return, m.actual_direction, 'sentiment' AS model, greatest(0e0, least(1e0, (({_sum}) + 1) / 2)) AS prob_up FROM {rows} m {fit}) x"""


V["sent_scores"] = sent_scores("model_test", "JOIN sent_fit USING (symbol)", "1e-1")


def model_rows(t):
    """Features with outcomes, zero-filled, and a 70/30 split in time."""
    base = price.price_features(t.bars).select("symbol", "date", "close", *MOMENTUM, *RSI, *MA_RATIO)
    feats = news.news_features(base, t.news).drop("close").na.fill(0.0)
    outcomes = t.preds.select("symbol", "date", "actual_return", "actual_direction")
    return time_split(feats.join(outcomes, ["symbol", "date"]), 0.7)


@query("rule_specialist_fit", "symbol momentum_col momentum_threshold:6 rsi_col rsi_oversold:6 rsi_overbought:6 ma_col", "SELECT * FROM rule_fit")
def _(t):
    return specialists.fit_rules(model_rows(t).where("split = 'train'"), "actual_direction")


@query("rule_specialist_scores", "symbol date model prob_up:6 confidence:6 signal:i", "SELECT * FROM rule_scores")
def _(t):
    rows = model_rows(t)
    return specialists.score_rules(rows.where("split = 'test'"), specialists.fit_rules(rows.where("split = 'train'"), "actual_direction"), min_confidence=0.4)


@query("sentiment_specialist_fit", "symbol " + " ".join(f"w_{c}:6" for c in NEWS), "SELECT * FROM sent_fit")
def _(t):
    return specialists.fit_sentiment(model_rows(t).where("split = 'train'"), "actual_direction")


@query("sentiment_specialist_scores", "symbol date model prob_up:6 confidence:6 signal:i", "SELECT * FROM sent_scores")
def _(t):
    rows = model_rows(t)
    weights = specialists.fit_sentiment(rows.where("split = 'train'"), "actual_direction")
    return specialists.score_sentiment(rows.where("split = 'test'"), weights, min_confidence=0.1)


V["wfm_preds"] = f"""SELECT symbol, date, model, confidence, signal, actual_return, actual_direction FROM ({rule_scores('wfm_test', 'wfm_rule_fit', 'symbol, window_id')}) r
  UNION ALL SELECT symbol, date, model, confidence, signal, actual_return, actual_direction FROM ({sent_scores('wfm_test', 'JOIN wfm_sent_fit USING (symbol, window_id)', '1e-1')}) s"""


@query("walk_forward_backtest", f"model symbol {SIG_COLS} {PNL_COLS}",
       f"SELECT * FROM ({signal_sql('wfm_preds', 'model, symbol')}) a JOIN ({pnl_sql(net_sql('wfm_preds', 'model, symbol'), 'model, symbol')}) b USING (model, symbol)")
def _(t):
    """Both closed-form specialists fitted on every window's training span; only its test span is scored, and the spans are stitched."""
    by = ["symbol", "window_id"]
    rows, windows = walk_forward_inputs(t)
    fits = specialists.walk_forward_fits(rows, windows, "actual_direction")
    test = moments.test_rows(rows, windows).join(fits, by)
    cols = ["symbol", "date", "model", "confidence", "signal", "actual_return", "actual_direction"]
    stitched = staged(specialists.score_both(test, 0.4, 0.1).select(*cols), "stitched")
    key = ["model", "symbol"]
    return signal_metrics(stitched, key).join(pnl_metrics(net_returns(stitched, key), key), key)


TRAIN_SYMBOLS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
_pool = "symbol IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')"
V["pool_train"] = f"SELECT *, 1 AS pool FROM model_rows WHERE {_pool}"
V["pool_test"] = f"SELECT *, 1 AS pool FROM model_rows WHERE NOT {_pool}"
V["pool_fit"] = "SELECT " + ", ".join(f"coalesce({rho_sql(c, 'actual_direction')}, 0e0) AS w_{c}" for c in NEWS) + " FROM pool_train"
_add_rule_fits("pool_", "pool_train", "pool")
V["pool_scores"] = f"""SELECT symbol, model, signal, actual_direction FROM ({rule_scores('pool_test', 'pool_rule_fit', 'pool', 'symbol')}) r
  UNION ALL SELECT symbol, model, signal, actual_direction FROM ({sent_scores('pool_test', ', pool_fit', '2e-2')}) s"""


@query("cross_symbol_transfer", "model symbol n_rows:i trades:i accuracy:6 coverage:6",
       """SELECT model, symbol, count(*) AS n_rows, count(*) FILTER (signal <> 0) AS trades, coalesce(count(*) FILTER (signal <> 0 AND signal = actual_direction) * 1e0 / nullif(count(*) FILTER (signal <> 0), 0), 0e0) AS accuracy,
       avg(CASE WHEN signal <> 0 THEN 1e0 ELSE 0e0 END) AS coverage FROM pool_scores GROUP BY model, symbol""")
def _(t):
    """Rules and news specialists fitted on a pool of symbols, judged on all others."""
    return pooled.transfer(staged(model_rows(t.stage("bars")), "model_rows"), TRAIN_SYMBOLS, news_confidence=0.02)


# ---- leakage tests that fit again in every window ----

SHIFTS, SEEDS = [-2, -1, 0, 1, 2], [42, 43, 44]
_moved = {f"{'early_' if k < 0 else 'late_'}{abs(k)}": k for k in SHIFTS}
_move = lambda c, k: c if not k else f"{'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER {W}"
V["shifted_labels"] = "SELECT *, " + ", ".join(f"{_move('actual_direction', k)} AS y_{n}, {_move('actual_return', k)} AS r_{n}" for n, k in _moved.items()) + " FROM model_rows"
_deals = " ".join(f"""JOIN (SELECT symbol, actual_direction AS y_shuffle_{s}, row_number() OVER (PARTITION BY symbol ORDER BY {draw(f"'{s}'", 'symbol', 'date')}, date) AS rn FROM model_rows) d{s} USING (symbol, rn)""" for s in SEEDS)
V["shuffled_labels"] = f"SELECT * FROM (SELECT *, row_number() OVER {W} AS rn FROM model_rows) m {_deals}"


def _refit_views(pre: str, source: str, variants: dict[str, tuple[str, str, str]]) -> None:
    labels = sorted({v[0] for v in variants.values()})
    known = " AND ".join(f"m.{c} IS NOT NULL" for c in sorted({c for v in variants.values() for c in v}))
    V[pre + "_rows"] = f"""SELECT m.*, w.window_id, CASE WHEN m.date < w.test_start THEN 'train' ELSE 'test' END AS role FROM {source} m
      JOIN wf_windows w ON m.symbol = w.symbol AND m.date >= w.train_start AND m.date < w.test_end WHERE {known}"""
    V[pre + "_fit"] = "SELECT symbol, window_id, " + ", ".join(f"coalesce({rho_sql(c, y)}, 0e0) AS w_{y}_{c}" for y in labels for c in NEWS) + f" FROM {pre}_rows WHERE role = 'train' GROUP BY symbol, window_id"
    parts = []
    for name, (label, judged, earned) in variants.items():
        total = " + ".join(f"{c} * w_{label}_{c}" for c in NEWS)
        parts.append(f"SELECT symbol, date, '{name}' AS variant, greatest(0e0, least(1e0, (({total}) + 1) / 2)) AS prob_up, {judged} AS actual_direction, {earned} AS actual_return FROM {pre}_rows JOIN {pre}_fit USING (symbol, window_id) WHERE role = 'test'")
    V[pre + "_scores"] = f"""SELECT *, CASE WHEN confidence < 1e-1 THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal
      FROM (SELECT *, 2 * abs(prob_up - 5e-1) AS confidence FROM ({' UNION ALL '.join(parts)}) v) x"""
    V[pre + "_metrics"] = f"SELECT * FROM ({signal_sql(pre + '_scores', 'symbol, variant')}) a JOIN ({pnl_sql(net_sql(pre + '_scores', 'symbol, variant'), 'symbol, variant')}) b USING (symbol, variant)"


_refit_views("moved_fit", "shifted_labels", {n: (f"y_{n}", f"y_{n}", f"r_{n}") for n in _moved})
_refit_views("dealt_fit", "shuffled_labels", {"true": ("actual_direction", "actual_direction", "actual_return")} | {f"shuffle_{s}": (f"y_shuffle_{s}", "actual_direction", "actual_return") for s in SEEDS})


def walk_forward_inputs(t):
    """(rows with buckets, windows), each computed once."""
    t = t.stage("bars")
    first = t.bars.groupBy("symbol").agg(F.expr("min(date) AS first_date"))
    return staged(moments.with_bucket(model_rows(t).drop("split"), first, 21), "model_rows"), staged(windows_calendar(t.bars), "windows")


@query("refit_time_shift_test", f"symbol variant {SIG_COLS} {PNL_COLS}", "SELECT * FROM moved_fit_metrics")
def _(t):
    return leakage.refit_time_shift(*walk_forward_inputs(t), SHIFTS)


@query("refit_label_shuffle_test", f"symbol variant {SIG_COLS} {PNL_COLS} passed:b",
       "SELECT *, abs(directional_accuracy - 5e-1) < 1e-1 AND total_return < 5e-2 AS passed FROM dealt_fit_metrics")
def _(t):
    return leakage.refit_label_shuffle(*walk_forward_inputs(t), SEEDS)


# ---- ensembles over a long prediction table ----

V["long_preds"] = """SELECT symbol, date, model, prob_up, confidence, signal FROM preds SEMI JOIN model_test USING (symbol, date) UNION ALL SELECT symbol, date, model, prob_up, confidence, signal FROM rule_scores
  UNION ALL SELECT symbol, date, model, prob_up, confidence, signal FROM sent_scores"""


def long_preds(t):
    """Predictions of the three specialists for rows that none of them was fitted on. ``t`` has its bars stored."""
    rows = staged(model_rows(t), "model_rows")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fits = specialists.fit_rules(train, "actual_direction").join(specialists.fit_sentiment(train, "actual_direction"), "symbol")
    cols = ["symbol", "date", "model", "prob_up", "confidence", "signal"]
    both = specialists.score_both(test.join(fits, "symbol"), 0.4, 0.1)
    momentum = t.preds.join(test.select("symbol", "date"), ["symbol", "date"], "left_semi")
    return momentum.select(*cols).unionByName(both.select(*cols))


def avg_sql(source: str, by: str) -> str:
    return f"""SELECT *, CASE WHEN confidence < 3e-1 THEN 0 WHEN avg_signal > 1e-1 THEN 1 WHEN avg_signal < -1e-1 THEN -1 ELSE 0 END AS signal FROM (
    SELECT {by}, avg(signal) AS avg_signal, avg(confidence) AS confidence, avg(prob_up) AS prob_up, count(*) AS n_models FROM {source} GROUP BY {by}) x"""


@query("average_ensemble", "symbol date prob_up:6 confidence:6 signal:i n_models:i", avg_sql("long_preds", "symbol, date"))
def _(t):
    return ensemble.score_simple_average(long_preds(t.stage("bars")), min_confidence=0.3)


CONFIGS = {"baseline": ["momentum", "rules", "sentiment"], "no_sentiment": ["momentum", "rules"], "no_rules": ["momentum", "sentiment"],
           "no_momentum": ["rules", "sentiment"], "momentum_only": ["momentum"], "rules_only": ["rules"], "sentiment_only": ["sentiment"]}
V["abl_preds"] = "SELECT p.*, c.configuration FROM long_preds p JOIN (VALUES " + ", ".join(
    f"('{c}', '{m}')" for c, ms in CONFIGS.items() for m in ms) + ") c(configuration, model) USING (model)"
V["abl_rows"] = f"SELECT a.*, o.actual_return, o.actual_direction FROM ({avg_sql('abl_preds', 'configuration, symbol, date')}) a JOIN preds o USING (symbol, date)"


@query("component_ablation", f"configuration symbol {SIG_COLS} {PNL_COLS}",
       f"""SELECT * FROM ({signal_sql('abl_rows', 'configuration, symbol')}) a JOIN ({pnl_sql(net_sql('abl_rows', 'configuration, symbol'), 'configuration, symbol')}) b
       USING (configuration, symbol)""")
def _(t):
    t = t.stage("bars")
    return ensemble.ablate(long_preds(t), t.preds.select("symbol", "date", "actual_return", "actual_direction"), CONFIGS, 0.3)


@query("classification_report", "symbol label:i support:i n_pred_0:i n_pred_1:i share_pred_0:6 share_pred_1:6 accuracy:6",
       """SELECT symbol, label, support, n_pred_0, n_pred_1, n_pred_0 * 1e0 / support AS share_pred_0, n_pred_1 * 1e0 / support AS share_pred_1,
       sum(hit) OVER (PARTITION BY symbol) * 1e0 / sum(support) OVER (PARTITION BY symbol) AS accuracy FROM (
       SELECT symbol, regime_vol AS label, count(*) AS support, count(*) FILTER (NOT hostile) AS n_pred_0, count(*) FILTER (hostile) AS n_pred_1,
       count(*) FILTER (hostile = (regime_vol = 1)) AS hit FROM (SELECT symbol, regime_vol, regime = 'HOSTILE' AS hostile FROM label_rows JOIN
         (SELECT symbol, date, regime FROM strategy_daily) g USING (symbol, date)) j GROUP BY 1, 2) c""")
def _(t):
    gate = regimes.vol_gate(t.bars).selectExpr("symbol", "date", "IF(regime = 'HOSTILE', 1, 0) AS predicted")
    return ensemble.classification_report(regimes.label_regimes(t.bars).join(gate, ["symbol", "date"]), "regime_vol", "predicted", [0, 1])


@query("minimum_trades", "symbol date period:i promoted signal:i",
       f"""SELECT symbol, date, period, coalesce(go, false) AS promoted, CASE WHEN go THEN (CASE WHEN prob_up > 5e-1 THEN 1 ELSE -1 END) ELSE signal END AS signal FROM (
       SELECT *, whole AND signal = 0 AND trades < 9 AND idle >= 9 - trades AND rk <= 9 - trades AS go FROM (
       SELECT *, count(*) FILTER (signal <> 0) OVER (PARTITION BY symbol, period) AS trades, count(*) FILTER (signal = 0) OVER (PARTITION BY symbol, period) AS idle,
       row_number() OVER (PARTITION BY symbol, period ORDER BY CASE WHEN signal = 0 THEN 0 ELSE 1 END, confidence DESC, date) AS rk FROM (
       SELECT *, rn // 21 AS period, rn // 21 < n // 21 AS whole FROM (SELECT *, row_number() OVER {W} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM preds) a) b) c) d""")
def _(t):
    return ensemble.min_trades(t.preds, 21, 9)


# ---- trees (no SQL equivalent: checked for rows only, and for skill in the tests) ----

REGIMES = ["regime_vol", "regime_trend", "regime_liq"]


def tree_rows(t):
    """(rows, features): every feature of the library, prices, index and news, zero-filled, with outcomes, labels and the 70/30 split."""
    feats = news.news_features(market.market_features(price.price_features(t.bars), t.index_bars), t.news)
    outcomes = t.preds.select("symbol", "date", "actual_return", "actual_direction")
    labels = regimes.label_regimes(t.bars).select("symbol", "date", *REGIMES)
    features = quality.feature_columns(feats)
    rows = feats.select("symbol", "date", *features).na.fill(0.0).join(outcomes, ["symbol", "date"]).join(labels, ["symbol", "date"])
    return staged(time_split(rows, 0.7), "tree_rows"), features


def boosted(t):
    rows, features = tree_rows(t.stage("bars"))
    model = trees.fit_gbt(rows.where("split = 'train'"), features, "actual_direction = 1")
    return trees.score(model, rows.where("split = 'test'"), "boosted", 0.1)


def regime_forests(t):
    rows, features = tree_rows(t.stage("bars"))
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    out = None
    for label in REGIMES:
        scored = trees.score(trees.fit_forest(train, features, label), test, label.replace("regime_", "") + "_forest", 0.1)
        out = scored if out is None else out.unionByName(scored)
    return out


@query("boosted_specialist", "symbol date model prob_up:6 confidence:6 signal:i")
def _(t):
    return boosted(t)


@query("regime_classifier", "symbol date model prob_up:6 confidence:6 signal:i")
def _(t):
    return regime_forests(t)


# Values of trees have no twin in SQL; their keys, ranges and the abstention rule have.
_valid = """bool_and(prob_up BETWEEN 0 AND 1 AND abs(confidence - 2 * abs(prob_up - 0.5D)) < 1e-12 AND
  signal = CASE WHEN confidence < 0.1D THEN 0 WHEN prob_up > 0.5D THEN 1 WHEN prob_up < 0.5D THEN -1 ELSE 0 END) AND max(prob_up) > min(prob_up)"""
V["tree_test"] = """SELECT symbol, date FROM (SELECT symbol, date, row_number() OVER w <= floor(count(*) OVER (PARTITION BY symbol) * 7e-1) AS early FROM preds
  JOIN (SELECT symbol, date FROM label_rows) l USING (symbol, date) WINDOW w AS (PARTITION BY symbol ORDER BY date)) x WHERE NOT early"""


@query("boosted_specialist_keys", "model symbol first_date last_date n_rows:i valid:b",
       "SELECT 'boosted' AS model, symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, true AS valid FROM tree_test GROUP BY symbol")
def _(t):
    return boosted(t).groupBy("model", "symbol").agg(F.expr("min(date) AS first_date"), F.expr("max(date) AS last_date"), F.expr("count(*) AS n_rows"), F.expr(f"{_valid} AS valid"))


@query("regime_classifier_keys", "model symbol first_date last_date n_rows:i valid:b",
       """SELECT model, symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, true AS valid
       FROM tree_test, (VALUES ('vol_forest'), ('trend_forest'), ('liq_forest')) m(model) GROUP BY model, symbol""")
def _(t):
    rated = regime_forests(t).groupBy("model", "symbol")
    return rated.agg(F.expr("min(date) AS first_date"), F.expr("max(date) AS last_date"), F.expr("count(*) AS n_rows"), F.expr(f"{_valid} AS valid"))


def trend_forest(t):
    rows, features = tree_rows(t.stage("bars"))
    return trees.fit_forest(rows.where("split = 'train'"), features, "regime_trend", 30), rows.where("split = 'test'"), features


@query("classifier_importance", "feature n_rows:i accuracy:6 drop:6 importance:6")
def _(t):
    """Permutation importance on rows the forest was not fitted on, beside the importance of its own splits."""
    model, test, features = trend_forest(t)
    return trees.permutation_importance(model, test, features, "regime_trend").join(trees.importances(model, features, test), "feature")


@query("classifier_confusion", "label:i support:i valid:b",
       """SELECT regime_trend AS label, count(*) AS support, true AS valid FROM tree_test JOIN label_rows USING (symbol, date) GROUP BY 1""")
def _(t):
    """Confusion of the trained forest on its test rows: supports are exact, shares add up."""
    model, test, _ = trend_forest(t)
    scored = model.transform(test).selectExpr("1 AS grp", "regime_trend", "CAST(prediction AS INT) AS predicted")
    report = ensemble.classification_report(scored, "regime_trend", "predicted", [0, 1], ["grp"])
    return report.selectExpr("label", "support", "n_pred_0 + n_pred_1 = support AND abs(share_pred_0 + share_pred_1 - 1) < 1e-12 AND accuracy BETWEEN 0.5D AND 1D AS valid")


@query("meta_ensemble", "symbol date prob_up:6 confidence:6 signal:i")
def _(t):
    t = t.stage("bars")
    context = price.price_features(t.bars).selectExpr("symbol", "date", "coalesce(volatility_5d, 0D) AS volatility")
    models = ["momentum", "rules", "sentiment"]
    stacked = trees.stack(long_preds(t), models, context).join(t.preds.select("symbol", "date", "actual_direction"), ["symbol", "date"])
    rows = time_split(stacked, 0.7)
    model = trees.fit_meta(rows.where("split = 'train'").drop("split"), trees.meta_features(models, ["volatility"]), "actual_direction = 1")
    return trees.score_meta(model, rows.where("split = 'test'").drop("split"), 0.3)
