"""Resampling, null strategy, synthetic path and stress queries."""

from __future__ import annotations

from barloom.operators import nulls, paths, regimes, resample, stress
from barloom.operators.regimes import vol_gate
from barloom.plans.stage import staged
from workloads.oracle import ORACLE_VIEWS as V
from workloads.q_backtest import conditional_sql
from workloads.registry import query
from workloads.sqlkit import RUN, W, draw, frame, normal, roll, uniform

N_PERM = 1000
PRUN = "(PARTITION BY symbol, path_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

V["gate_idx"] = f"SELECT *, row_number() OVER {W} - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM strategy_daily"
V["perm_ids"] = f"SELECT unnest(range(0, {N_PERM})) AS path_id"
V["sym_n"] = "SELECT DISTINCT symbol, n FROM gate_idx"
V["boot_blocks"] = f"""SELECT symbol, path_id, b, n, {draw("'42'", 'symbol', 'path_id', 'b')} % greatest(n - 20, 1) AS start FROM (
  SELECT symbol, n, path_id, unnest(range(0, CAST(ceil(n / 20e0) AS BIGINT))) AS b FROM sym_n, perm_ids) x"""
V["boot_rows"] = """SELECT k.symbol, k.path_id, k.t, r.ret, p.position FROM (
  SELECT symbol, path_id, start, b, b * 20 + unnest(range(0, 20)) AS t, n FROM boot_blocks) k
  JOIN gate_idx r ON r.symbol = k.symbol AND r.t = k.start + k.t - k.b * 20 JOIN gate_idx p ON p.symbol = k.symbol AND p.t = k.t WHERE k.t < k.n"""


def dd_crash_sql(source: str) -> str:
    return f"""SELECT symbol, path_id, min(e / pk - 1) AS max_dd, coalesce(avg(position) FILTER (ret < -2e-2), 0e0) AS crash_exposure FROM (
    SELECT *, max(e) OVER {PRUN} AS pk FROM (SELECT *, product(1 + ret * position) OVER {PRUN} AS e FROM ({source}) a) b) c GROUP BY 1, 2"""


V["boot_metrics"] = dd_crash_sql("SELECT * FROM boot_rows")
V["shuf_rows"] = f"""SELECT a.symbol, a.path_id, a.t, b.ret, a.position FROM (
  SELECT symbol, path_id, t, position, regime, row_number() OVER (PARTITION BY symbol, path_id, regime ORDER BY t) AS k FROM gate_idx, perm_ids) a JOIN (
  SELECT symbol, path_id, ret, regime, row_number() OVER (PARTITION BY symbol, path_id, regime ORDER BY {draw("'42'", 'symbol', 'path_id', 't')}, t) AS k FROM gate_idx, perm_ids) b
  USING (symbol, path_id, regime, k)"""
V["shuf_metrics"] = dd_crash_sql("SELECT * FROM shuf_rows")
V["full_rows"] = f"""SELECT a.symbol, a.path_id, a.t, b.ret, a.position FROM (
  SELECT symbol, path_id, t, position, t + 1 AS k FROM gate_idx, perm_ids) a JOIN (
  SELECT symbol, path_id, ret, row_number() OVER (PARTITION BY symbol, path_id ORDER BY {draw("'42'", 'symbol', 'path_id', 't')}, t) AS k FROM gate_idx, perm_ids) b
  USING (symbol, path_id, k)"""
V["real_metrics"] = dd_crash_sql("SELECT symbol, 0 AS path_id, t, ret, position FROM gate_idx")


def gate_arrays(t):
    gate = vol_gate(t.bars).selectExpr("symbol", "date", "ret", "CAST(position AS DOUBLE) AS position", "regime")
    return resample.series_arrays(gate, ["ret", "position", "regime"])


@query("block_bootstrap", "symbol path_id:i max_dd:6 crash_exposure:6", "SELECT * FROM boot_metrics")
def _(t):
    return resample.resample_metrics(resample.block_bootstrap(gate_arrays(t), N_PERM))


@query("regime_shuffle", "symbol path_id:i max_dd:6 crash_exposure:6", "SELECT * FROM shuf_metrics")
def _(t):
    return resample.resample_metrics(resample.regime_shuffle(gate_arrays(t), N_PERM))


@query("full_shuffle", "symbol path_id:i max_dd:6 crash_exposure:6", dd_crash_sql("SELECT * FROM full_rows"))
def _(t):
    return resample.resample_metrics(resample.regime_shuffle(gate_arrays(t), N_PERM, regime=None))


V["perm_summary"] = """SELECT n.symbol, count(*) AS n_permutations, max(r.max_dd) * 100 AS real_max_dd, max(r.crash_exposure) * 100 AS real_crash_exposure,
  avg(CASE WHEN round(n.max_dd, 9) < round(r.max_dd, 9) THEN 1e0 ELSE 0e0 END) * 100 AS dd_percentile, avg(CASE WHEN round(n.crash_exposure, 9) > round(r.crash_exposure, 9) THEN 1e0 ELSE 0e0 END) * 100 AS crash_percentile,
  avg(n.max_dd) * 100 AS null_max_dd_mean, stddev_pop(n.max_dd) * 100 AS null_max_dd_std, quantile_cont(n.max_dd, 0.05) * 100 AS null_max_dd_p05,
  quantile_cont(n.max_dd, 0.95) * 100 AS null_max_dd_p95, avg(n.crash_exposure) * 100 AS null_crash_exposure_mean, stddev_pop(n.crash_exposure) * 100 AS null_crash_exposure_std,
  quantile_cont(n.crash_exposure, 0.05) * 100 AS null_crash_exposure_p05, quantile_cont(n.crash_exposure, 0.95) * 100 AS null_crash_exposure_p95 FROM boot_metrics n JOIN real_metrics r USING (symbol) GROUP BY n.symbol"""


@query("permutation_summary",
       "symbol n_permutations:i real_max_dd:6 real_crash_exposure:6 dd_percentile:6 crash_percentile:6 null_max_dd_mean:6 null_max_dd_std:6 "
       "null_max_dd_p05:6 null_max_dd_p95:6 null_crash_exposure_mean:6 null_crash_exposure_std:6 null_crash_exposure_p05:6 null_crash_exposure_p95:6 overall_pass",
       "SELECT *, dd_percentile >= 95 AND crash_percentile >= 95 AS overall_pass FROM perm_summary")
def _(t):
    arrays = gate_arrays(t)
    return resample.permutation_summary(arrays, resample.resample_metrics(resample.block_bootstrap(arrays, N_PERM)))


V["expo_rows"] = f"""SELECT symbol, date, open, CASE WHEN lattice_state = 0 THEN 0e0 ELSE 1e0 END AS exposure, row_number() OVER {W} AS k FROM lattice_rows"""
V["expo_perm"] = f"""SELECT a.symbol, a.path_id, a.date, a.open, b.exposure AS signal FROM (SELECT *, unnest(range(0, 50)) AS path_id FROM expo_rows) a JOIN (
  SELECT symbol, path_id, exposure, row_number() OVER (PARTITION BY symbol, path_id ORDER BY {draw("'42'", 'symbol', 'path_id', '(k - 1)')}, k) AS k
  FROM (SELECT *, unnest(range(0, 50)) AS path_id FROM expo_rows) z) b USING (symbol, path_id, k)"""


@query("state_shuffle_pvalue", "symbol real_total_return:6 real_sharpe:6 p_value:6 null_mean_return:6 null_p95_return:6 significant beats_p95",
       f"""SELECT *, p_value < 5e-2 AS significant, real_total_return > null_p95_return AS beats_p95 FROM (
       SELECT symbol, max(r.total_return) AS real_total_return, max(r.sharpe) AS real_sharpe, avg(CASE WHEN round(n.sharpe, 9) >= round(r.sharpe, 9) THEN 1e0 ELSE 0e0 END) AS p_value,
       avg(n.total_return) AS null_mean_return, quantile_cont(n.total_return, 0.95) AS null_p95_return
       FROM ({conditional_sql('SELECT * FROM expo_perm', 'symbol, path_id')}) n
       JOIN ({conditional_sql('SELECT *, exposure AS signal FROM expo_rows')}) r USING (symbol) GROUP BY symbol) z""")
def _(t):
    from barloom.operators.news import target_open_to_open

    df = target_open_to_open(regimes.exposure(regimes.lattice(regimes.label_regimes(t.bars))))
    return resample.state_shuffle_test(df.selectExpr("symbol", "date", "exposure", "next_day_return AS next_open_return"))


# ---- null strategies ----

V["null_base"] = f"""SELECT symbol, date, ret, position * 1e0 AS position, sum(moved) OVER (PARTITION BY symbol) * 1e0 / count(*) OVER (PARTITION BY symbol) AS rate
  FROM (SELECT *, CASE WHEN position <> lag(position) OVER {W} THEN 1 ELSE 0 END AS moved FROM strategy_daily) x"""
V["null_pos"] = f"""SELECT symbol, date, ret, 'Real' AS strategy, 0 AS draw, position FROM null_base
  UNION ALL SELECT symbol, date, ret, 'Always-Long', 0, 1e0 FROM null_base UNION ALL SELECT symbol, date, ret, 'Inverse', 0, 1 - position FROM null_base
  UNION ALL SELECT symbol, date, ret, 'Delayed-T+2', 0, lag(position, 2, 1e0) OVER {W} FROM null_base
  UNION ALL SELECT symbol, date, ret, 'Delayed-T+3', 0, lag(position, 3, 1e0) OVER {W} FROM null_base
  UNION ALL SELECT symbol, date, ret, 'Random', k, CAST((1 + sum(f) OVER (PARTITION BY symbol, k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) % 2 AS DOUBLE)
    FROM (SELECT *, CASE WHEN {uniform('(42 + k)', 'symbol', 'date')} < rate THEN 1 ELSE 0 END AS f FROM null_base, (SELECT unnest(range(0, 10)) AS k) kk) fl"""
NRUN = "(PARTITION BY symbol, strategy, draw ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
V["null_metrics"] = f"""SELECT symbol, strategy, draw, (product(1 + s) - 1) * 100 AS total_return, round(min(e / pk - 1) * 100, 9) AS max_drawdown,
  CASE WHEN stddev_samp(s) > 0 THEN avg(s) / stddev_samp(s) * sqrt(252e0) ELSE 0e0 END AS sharpe, round(coalesce(avg(position) FILTER (ret < -2e-2), 0e0) * 100, 9) AS crash_exposure,
  sum(moved) AS turnover FROM (SELECT *, max(e) OVER {NRUN} AS pk FROM (SELECT *, ret * position AS s, product(1 + ret * position) OVER {NRUN} AS e,
  CASE WHEN position <> lag(position) OVER (PARTITION BY symbol, strategy, draw ORDER BY date) THEN 1 ELSE 0 END AS moved FROM null_pos) a) b GROUP BY 1, 2, 3"""
V["null_rows"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, strategy ORDER BY max_drawdown, draw) AS rk FROM null_metrics) x WHERE strategy <> 'Random' OR rk = 6"""
V["null_cmp"] = """SELECT n.symbol, n.strategy, r.max_drawdown - n.max_drawdown AS dd_improvement, n.crash_exposure - r.crash_exposure AS crash_improvement,
  r.total_return - n.total_return AS return_delta, r.max_drawdown > n.max_drawdown AS real_wins_dd, r.crash_exposure < n.crash_exposure AS real_wins_crash
  FROM null_rows n JOIN null_rows r ON n.symbol = r.symbol AND r.strategy = 'Real' WHERE n.strategy <> 'Real'"""
V["null_pass"] = "SELECT symbol, avg(CASE WHEN real_wins_dd THEN 1e0 ELSE 0e0 END) AS dd_win_rate, avg(CASE WHEN real_wins_dd THEN 1e0 ELSE 0e0 END) >= 8e-1 AS passed FROM null_cmp GROUP BY symbol"


@query("null_strategy_positions", "symbol date strategy draw:i position:1", "SELECT * FROM null_pos")
def _(t):
    return nulls.null_positions(vol_gate(t.bars))


@query("null_strategy_results", "symbol strategy total_return:6 max_drawdown:6 sharpe:6 crash_exposure:6 turnover:i", "SELECT * FROM null_rows")
def _(t):
    return nulls.null_results(vol_gate(t.bars))


@query("null_comparison", "symbol strategy dd_improvement:6 crash_improvement:6 return_delta:6 real_wins_dd real_wins_crash", "SELECT * FROM null_cmp")
def _(t):
    return nulls.compare_nulls(nulls.null_results(vol_gate(t.bars)))


@query("null_verdict", "symbol dd_win_rate:6 passed", "SELECT * FROM null_pass")
def _(t):
    return nulls.null_verdict(nulls.compare_nulls(nulls.null_results(vol_gate(t.bars))))


# ---- synthetic paths ----

V["path_runs"] = f"""SELECT symbol, run_id, regime, min(t) AS t0, count(*) AS len, row_number() OVER (PARTITION BY symbol ORDER BY run_id) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS nr,
  min(count(*)) OVER (PARTITION BY symbol) AS shortest FROM (SELECT *, sum(s) OVER {RUN} AS run_id FROM (
  SELECT *, CASE WHEN regime = lag(regime) OVER {W} THEN 0 ELSE 1 END AS s FROM gate_idx) a) b GROUP BY 1, 2, 3"""
V["boot_picks"] = f"""SELECT symbol, path_id, k, {draw("'42'", "'runs'", 'symbol', 'path_id', 'k')} % nr AS pick FROM (
  SELECT symbol, nr, path_id, unnest(range(0, CAST(ceil(500e0 / shortest) AS BIGINT))) AS k FROM (SELECT DISTINCT symbol, nr, shortest FROM path_runs) d, (SELECT unnest(range(0, 10)) AS path_id) p) x"""
V["boot_seq"] = """SELECT p.symbol, p.path_id, p.k, r.t0, r.len, r.regime, sum(r.len) OVER (PARTITION BY p.symbol, p.path_id ORDER BY p.k) - r.len AS offs
  FROM boot_picks p JOIN path_runs r ON r.symbol = p.symbol AND r.k = p.pick"""
V["path_boot"] = """SELECT s.symbol, 'RegimeBootstrap' AS path_type, s.path_id, CAST(s.offs + s.j AS BIGINT) AS t, g.ret, s.regime, 1e0 AS position
  FROM (SELECT *, unnest(range(0, len)) AS j FROM boot_seq WHERE offs < 500) s JOIN gate_idx g ON g.symbol = s.symbol AND g.t = s.t0 + s.j WHERE s.offs + s.j < 500"""
V["crisis_v"] = f"SELECT *, {roll('stddev_samp', 'ret', 20)} AS v FROM gate_idx"
V["crisis_cut"] = "SELECT symbol, quantile_cont(v, 0.8) AS q, quantile_cont(ret, 0.1) AS cut_low FROM crisis_v GROUP BY symbol"
V["crisis_pick"] = """SELECT symbol, count(*) FILTER (v > q) AS wild FROM crisis_v JOIN crisis_cut USING (symbol) GROUP BY symbol"""
V["crisis_rows"] = f"""SELECT symbol, ret, row_number() OVER {W} - 1 AS k, count(*) OVER (PARTITION BY symbol) AS m FROM crisis_v JOIN crisis_cut USING (symbol) JOIN crisis_pick USING (symbol)
  WHERE CASE WHEN wild < 20 THEN ret < cut_low ELSE v > q END"""
V["crisis_m"] = "SELECT DISTINCT symbol, m FROM crisis_rows"
V["stitch_blocks"] = f"""SELECT symbol, path_id, c, p0 + j AS t, {draw("'42'", "'day'", 'symbol', 'path_id', 'c', 'j')} % m AS pick FROM (
  SELECT symbol, m, path_id, c, 20 + {draw("'42'", "'point'", 'symbol', 'path_id', 'c')} % (n - 40) AS p0, unnest(range(0, least(20, m))) AS j
  FROM sym_n JOIN crisis_m USING (symbol), (SELECT unnest(range(0, 10)) AS path_id) p, (SELECT unnest(range(0, 3)) AS c) cc WHERE n > 40) x"""
V["stitch_last"] = "SELECT symbol, path_id, t, max_by(pick, c) AS pick FROM stitch_blocks GROUP BY 1, 2, 3"
V["stitch_ret"] = """SELECT g.symbol, p.path_id, g.t, g.position * 1e0 AS position, CASE WHEN s.pick IS NULL THEN g.ret ELSE 15e-1 * c.ret END AS ret
  FROM gate_idx g JOIN (SELECT unnest(range(0, 10)) AS path_id) p ON g.n > 40 LEFT JOIN stitch_last s ON s.symbol = g.symbol AND s.path_id = p.path_id AND s.t = g.t
  LEFT JOIN crisis_rows c ON c.symbol = s.symbol AND c.k = s.pick"""
V["stitch_vol"] = "SELECT *, " + roll("stddev_samp", "ret", 5, "symbol, path_id", "t") + " AS v FROM stitch_ret"
V["path_stitch"] = """SELECT symbol, 'CrisisStitch' AS path_type, path_id, t, ret, CASE WHEN round(v, 9) > round(q, 9) THEN 'HOSTILE' ELSE 'NEUTRAL' END AS regime, position
  FROM stitch_vol JOIN (SELECT symbol, path_id, quantile_cont(v, 0.8) AS q FROM stitch_vol GROUP BY 1, 2) z USING (symbol, path_id)"""
V["path_back"] = f"""SELECT x.symbol, 'BackToBackCrisis' AS path_type, path_id, t, c.ret, 'HOSTILE' AS regime, 1e0 AS position FROM (
  SELECT symbol, path_id, t, {draw("'42'", "'back'", 'symbol', 'path_id', 't')} % m AS pick FROM (SELECT symbol, m, path_id, unnest(range(0, 100)) AS t FROM crisis_m, (SELECT unnest(range(0, 3)) AS path_id) p) y) x
  JOIN crisis_rows c ON c.symbol = x.symbol AND c.k = x.pick"""
V["path_whip"] = f"""SELECT symbol, 'Whipsaw' AS path_type, path_id, t, CASE WHEN (t + 1) % (3 + path_id) = 0 AND t < n - 1 THEN ret * (15e-1 + {uniform("'42'", "'whip'", 'symbol', 'path_id', 't')}) ELSE ret END AS ret,
  CASE WHEN (t // (3 + path_id)) % 2 = 0 THEN 'HOSTILE' ELSE 'NEUTRAL' END AS regime, position * 1e0 AS position FROM gate_idx, (SELECT unnest(range(0, 10)) AS path_id) p"""
V["path_false"] = f"""SELECT symbol, 'FalseRiskOff' AS path_type, path_id, t, {normal(0.002, 0.01, "'42'", "'rally'", 'symbol', 'path_id', 't')} AS ret, 'HOSTILE' AS regime, position * 1e0 AS position
  FROM gate_idx, (SELECT unnest(range(0, 5)) AS path_id) p"""
V["path_shock"] = f"""SELECT symbol, 'CorrShock' AS path_type, 0 AS path_id, t, {normal(0.0, 0.02, "'42'", "'common'", '0', 't')} + {normal(0.0, 0.002, "'42'", "'noise'", 'symbol', '0', 't')} AS ret,
  'NEUTRAL' AS regime, position * 1e0 AS position FROM gate_idx"""
PATH_COLS = "symbol path_id:i t:i ret:8 regime position:1"


def gated(t):
    return vol_gate(t.bars).selectExpr("symbol", "date", "ret", "CAST(position AS DOUBLE) AS position", "regime")


@query("paths_regime_bootstrap", PATH_COLS, "SELECT * FROM path_boot")
def _(t):
    return paths.explode_paths(paths.regime_bootstrap(gated(t)))


@query("paths_crisis_stitch", PATH_COLS, "SELECT * FROM path_stitch")
def _(t):
    return paths.explode_paths(paths.crisis_stitch(gated(t)))


@query("crisis_days", "symbol definition n_days:i",
       "SELECT symbol, CASE WHEN wild < 20 THEN 'lowest' ELSE 'volatile' END AS definition, count(k) AS n_days FROM crisis_pick LEFT JOIN crisis_rows USING (symbol) GROUP BY 1, 2")
def _(t):
    return paths.crisis_returns(gated(t)).selectExpr("symbol", "definition", "size(crisis) AS n_days")


@query("paths_back_to_back", PATH_COLS, "SELECT * FROM path_back")
def _(t):
    return paths.explode_paths(paths.back_to_back_crisis(gated(t)))


@query("paths_whipsaw", PATH_COLS, "SELECT * FROM path_whip")
def _(t):
    return paths.explode_paths(paths.whipsaw(gated(t)))


@query("paths_false_risk_off", PATH_COLS, "SELECT * FROM path_false")
def _(t):
    return paths.explode_paths(paths.false_risk_off(gated(t)))


@query("paths_correlation_shock", PATH_COLS, "SELECT * FROM path_shock")
def _(t):
    return paths.explode_paths(paths.correlation_shock(gated(t)))


V["path_all"] = " UNION ALL ".join(f"SELECT symbol, path_type, path_id, t, ret, position FROM {v}" for v in ("path_boot", "path_stitch", "path_back", "path_whip", "path_false"))
ARUN = "(PARTITION BY symbol, path_type, path_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
V["path_res"] = f"""SELECT symbol, path_type, path_id, min(e / pk - 1) AS max_dd, product(1 + ret * position) - 1 AS final_return FROM (
  SELECT *, max(e) OVER {ARUN} AS pk FROM (SELECT *, product(1 + ret * position) OVER {ARUN} AS e FROM path_all) a) b GROUP BY 1, 2, 3"""
V["surv_rows"] = """SELECT symbol, count(*) AS paths_tested, count(*) FILTER (max_dd > -25e-2) AS survived, avg(CASE WHEN max_dd > -25e-2 THEN 1e0 ELSE 0e0 END) AS survival_rate,
  min(max_dd) * 100 AS worst_dd, arg_min(path_type, {'d': round(max_dd, 9), 'p': path_type}) AS worst_path, avg(CASE WHEN max_dd > -25e-2 THEN 1e0 ELSE 0e0 END) >= 95e-2 AS passed FROM path_res GROUP BY symbol"""


@query("path_results", "symbol path_type path_id:i max_dd:6 final_return:6 survived", "SELECT *, max_dd > -25e-2 AS survived FROM path_res")
def _(t):
    return paths.path_results(paths.hostile_suite(staged(gated(t), "gate")))


@query("path_survival", "symbol paths_tested:i survived:i survival_rate:6 worst_dd:6 worst_path passed", "SELECT * FROM surv_rows")
def _(t):
    return paths.survival(paths.path_results(paths.hostile_suite(staged(gated(t), "gate"))))


# ---- portfolio stress ----

V["book"] = """SELECT concat('P', CAST((CAST(substr(symbol, 7) AS INTEGER) - 1) // 4 AS VARCHAR)) AS portfolio_id, symbol, date, ret, position FROM strategy_daily"""
V["book_common"] = """SELECT * FROM book WHERE (portfolio_id, date) IN (SELECT (portfolio_id, date) FROM book JOIN
  (SELECT portfolio_id, count(DISTINCT symbol) AS m FROM book GROUP BY 1) mm USING (portfolio_id) GROUP BY portfolio_id, date, m HAVING count(*) = m)"""
V["scen"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c!r}::DOUBLE, {m!r}::DOUBLE, {d})" for n, c, m, d in stress.SCENARIOS) + ") s(scenario, correlation, mult, delay)"
V["st_pos"] = f"""SELECT *, CASE delay WHEN 0 THEN position * 1e0 WHEN 1 THEN lag(position, 1, 1) OVER (PARTITION BY symbol, scenario ORDER BY date) * 1e0
  ELSE lag(position, 2, 1) OVER (PARTITION BY symbol, scenario ORDER BY date) * 1e0 END AS p FROM book_common, scen"""
V["st_rows"] = f"""SELECT portfolio_id, symbol, date, scenario, ((CASE WHEN correlation <= 3e-1 THEN ret ELSE correlation * {normal(0.0, 0.015, "'42'", "'factor'", 'scenario', 'date')} + (1 - correlation) * ret END)
  - chg * 5e-4 * mult) * p AS sr FROM (SELECT *, abs(p - lag(p) OVER (PARTITION BY symbol, scenario ORDER BY date)) AS chg FROM st_pos) x WHERE chg IS NOT NULL"""


def dd_sql(source: str, by: str, x: str) -> str:
    r = f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT {by}, min(e / pk - 1) AS dd FROM (SELECT *, max(e) OVER {r} AS pk FROM (SELECT *, product(1 + {x}) OVER {r} AS e FROM ({source}) a) b) c GROUP BY {by}"


V["st_port"] = dd_sql("SELECT portfolio_id, scenario, date, sum(sr) / max(m) AS pr FROM st_rows JOIN (SELECT portfolio_id, count(DISTINCT symbol) AS m FROM st_rows GROUP BY 1) mm USING (portfolio_id) GROUP BY 1, 2, 3",
                      "portfolio_id, scenario", "pr")
V["st_sum"] = """SELECT portfolio_id, count(*) AS total_scenarios, count(*) FILTER (dd > -1e-1) AS scenarios_passed, avg(CASE WHEN dd > -1e-1 THEN 1e0 ELSE 0e0 END) AS survival_rate,
  min(dd) * 100 AS worst_dd, arg_min(scenario, {'d': round(dd * 100, 9), 's': scenario}) AS worst_scenario, avg(CASE WHEN dd > -1e-1 THEN 1e0 ELSE 0e0 END) >= 99e-2 AS overall_pass FROM st_port GROUP BY portfolio_id"""


def book(t):
    return book_of(vol_gate(t.bars))


def book_of(gate):
    return gate.selectExpr("concat('P', CAST((CAST(substr(symbol, 7) AS INT) - 1) DIV 4 AS STRING)) AS portfolio_id", "symbol", "date", "ret", "position")


@query("stress_asset_drawdowns", "portfolio_id symbol scenario asset_dd:6", "SELECT *, dd * 100 AS asset_dd FROM (" + dd_sql("SELECT * FROM st_rows", "portfolio_id, symbol, scenario", "sr") + ") z")
def _(t):
    return stress.asset_drawdowns(stress.stressed_returns(staged(book(t), "book")))


@query("portfolio_stress", "portfolio_id scenario portfolio_dd:6 kill_switch_triggered survived",
       "SELECT portfolio_id, scenario, dd * 100 AS portfolio_dd, dd <= -1e-1 AS kill_switch_triggered, dd > -1e-1 AS survived FROM st_port")
def _(t):
    return stress.portfolio_stress(stress.stressed_returns(staged(book(t), "book")))


@query("stress_summary", "portfolio_id total_scenarios:i scenarios_passed:i survival_rate:6 worst_dd:6 worst_scenario overall_pass", "SELECT * FROM st_sum")
def _(t):
    return stress.stress_summary(stress.portfolio_stress(stress.stressed_returns(staged(book(t), "book"))))


@query("falsification_verdict", "symbol portfolio_id null_pass permutation_pass survival_pass stress_pass overall_pass",
       """SELECT *, null_pass AND permutation_pass AND survival_pass AND stress_pass AS overall_pass FROM (
       SELECT m.symbol, m.portfolio_id, coalesce(n.passed, false) AS null_pass, coalesce(p.dd_percentile >= 95 AND p.crash_percentile >= 95, false) AS permutation_pass,
       coalesce(s.passed, false) AS survival_pass, coalesce(x.overall_pass, false) AS stress_pass FROM (SELECT DISTINCT symbol, portfolio_id FROM book) m
       LEFT JOIN null_pass n USING (symbol) LEFT JOIN perm_summary p USING (symbol) LEFT JOIN surv_rows s USING (symbol) LEFT JOIN st_sum x USING (portfolio_id)) v""")
def _(t):
    """All four phases from one stored gate; the book and the portfolio returns are stored too, as phases read them again."""
    gate = staged(gated(t), "gate")
    arrays = staged(resample.series_arrays(gate, ["ret", "position", "regime"]), "arrays")
    held = staged(book_of(gate), "book")
    return stress.verdict(
        nulls.null_verdict(nulls.compare_nulls(staged(nulls.null_results(gate), "nulls"))),
        resample.permutation_summary(arrays, resample.resample_metrics(resample.block_bootstrap(arrays, N_PERM))),
        paths.survival(paths.path_results(paths.hostile_suite(gate))),
        stress.stress_summary(stress.portfolio_stress(stress.stressed_returns(held))), held)
