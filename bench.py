"""Benchmark: python bench.py prints one JSON line with the seconds of every headline query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (name parts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.operators import backtest, killswitch, market, news, nulls, paths, portfolio, price, quality, reconcile, regimes, resample, stress, telemetry
from barloom.operators.regimes import vol_gate
from barloom.plans.gate import gate_versus_hold
from barloom.plans.stage import staged
from barloom.session import build_session
from workloads import q_falsify, q_models
from workloads.views import Inputs

THRESHOLDS = [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65]
COST_BPS = [0.0, 5.0, 10.0, 20.0, 50.0]


def full_features(t: Inputs):
    df = news.news_features(market.market_features(price.price_features(t.bars), t.index_bars), t.news)
    return quality.finalize_features(news.target_open_to_open(df))


def permutation_1000(t: Inputs):
    arrays = q_falsify.gate_arrays(t)
    return resample.permutation_summary(arrays, resample.resample_metrics(resample.block_bootstrap(arrays, 1000)))


def threshold_by_cost(t: Inputs):
    grid = ", ".join(f"struct({x!r}D AS threshold, {c!r}D AS cost_bps)" for x in THRESHOLDS for c in COST_BPS)
    rows = t.preds.drop("signal").selectExpr("*", f"inline(array({grid}))")
    key = ["symbol", "threshold", "cost_bps"]
    return backtest.pnl_metrics(backtest.net_returns(backtest.abstain(rows, "threshold"), key, rate="cost_bps / 10000D"), key)


QUERIES = {
    "gate_versus_hold": lambda t: gate_versus_hold(t.bars),
    "full_features": full_features,
    "regime_labels": lambda t: regimes.lattice(regimes.label_regimes(t.bars)),
    "permutation_1000": permutation_1000,
    "threshold_by_cost": threshold_by_cost,
    "null_comparison": lambda t: nulls.compare_nulls(nulls.null_results(vol_gate(t.bars))),
    "path_survival": lambda t: paths.survival(paths.path_results(paths.hostile_suite(staged(q_falsify.gated(t), "gate")))),
    "portfolio_stress": lambda t: stress.portfolio_stress(stress.stressed_returns(staged(q_falsify.book(t), "book"))),
    "specialist_scores": lambda t: q_models.long_preds(t.stage("bars")),
    "correlation_matrix": lambda t: portfolio.correlation_matrix(vol_gate(t.bars)),
    "slippage_stats": lambda t: telemetry.slippage_stats(telemetry.slippage(t.fills)),
    "fill_reconciliation": lambda t: reconcile.reconcile_fills(t.order_ledger, t.broker_fills),
    "kill_switch": lambda t: killswitch.kill_switch(t.account_events),
    "news_sentiment": lambda t: news.headline_sentiment(t.news),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = build_session(f"local[{cpus}]", int(cpus), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name, build in QUERIES.items():
        if only and not any(part in name for part in only):
            continue
        start = time.perf_counter()
        build(Inputs(spark, folder)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
