"""Registered queries against DuckDB on the smallest tables; ALL_QUERIES=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF
from tools.check_oracle import compare

SAMPLE = (
    "gate_versus_hold", "price_returns", "price_moving_averages", "rolling_beta", "news_rolling", "regime_labels", "pnl_summary", "threshold_sweep",
    "pnl_attribution_summary", "edge_health_score", "stability_report", "regime_transitions", "decay_status", "slippage_stats", "fill_reconciliation",
    "kill_switch_actions", "correlation_matrix", "block_bootstrap", "null_comparison", "covered_call_grid", "margin_admission", "walk_forward_windows",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.count() == 25 and "dd_improvement" in df.columns


def test_every_statement_binds(duck):
    for name, sql in entry_points.oracle_sql().items():
        duck.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry_points.oracle_sql()[name])
    assert compare(name, rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
