"""Telemetry, reconciliation, portfolio, sources and the bucketed scans."""

import datetime as dt
import json
import tempfile

import numpy as np
import pandas as pd
import pytest

from barloom.functions import scan
from barloom.operators import margin, options, portfolio, reconcile, telemetry
from barloom.sources import bars as bar_sources, logs, news as news_sources
from tests.helpers import by_key, random_bars

DAY = dt.date(2023, 1, 2)
DEC = "symbol string, date date, ts timestamp, action string, regime string, price double"


def decision(spark, *rows):
    return spark.createDataFrame([("SPY", DAY, dt.datetime(2023, 1, 2, h), a, r, p) for h, a, r, p in rows], DEC)


def test_aligned_decision_and_slippage(spark):
    m = reconcile.match_decisions(decision(spark, (9, "ENTER_LONG", "NEUTRAL", 450.0)), decision(spark, (9, "ENTER_LONG", "NEUTRAL", 450.10)))
    row = m.first()
    assert row.is_aligned and row.slippage_bps == pytest.approx(2.2, abs=0.05)


def test_last_write_wins_and_missed_exit(spark):
    expected = decision(spark, (9, "HOLD", "NEUTRAL", 450.0), (10, "EXIT_TO_CASH", "HOSTILE", 450.0))
    report = reconcile.reconciliation_report(reconcile.match_decisions(expected, decision(spark, (11, "HOLD", "NEUTRAL", 450.0)))).first()
    assert (report.missed_exits, report.regime_misclassifications, report.aligned_decisions) == (1, 1, 0)


def test_shadow_parity_without_overlap_is_one(spark):
    live = decision(spark, (9, "HOLD", "NEUTRAL", 1.0))
    assert reconcile.shadow_parity(live, live.where("false")).first().alignment_rate == 1.0


def test_orders_against_fills(spark):
    schema = "client_order_id string, filled_qty double, avg_price double"
    orders = spark.createDataFrame([("a", 100.0, 450.0), ("b", 10.0, 20.0)], schema)
    assert reconcile.reconcile_fills(orders, orders.where("client_order_id = 'a'")).count() == 0
    bad = spark.createDataFrame([("b", 9.0, 20.5), ("z", 1.0, 1.0)], schema)
    assert sorted(r.issue for r in reconcile.reconcile_fills(orders, bad).collect()) == ["price_mismatch", "quantity_mismatch", "unknown_fill"]


def test_fill_slippage_sign(spark):
    rows = [("1", "A", s, 100.0, 100.75, 10.0, dt.datetime(2023, 1, 2), dt.datetime(2023, 1, 2, 0, 0, 1), False) for s in ("buy", "sell")]
    fills = spark.createDataFrame(rows, "order_id string, symbol string, side string, expected_price double, actual_fill_price double, qty double, submit_ts timestamp, fill_ts timestamp, partial_fill boolean")
    out = by_key(telemetry.slippage(fills), "side")
    assert list(out["slippage_bps"]) == pytest.approx([75.0, -75.0]) and out["time_delay_ms"][0] == 1000.0
    assert telemetry.daily_slippage(telemetry.slippage(fills)).first().breach


def test_parked_cash(spark):
    rows = [(v, 10_000.0, DAY, DAY + dt.timedelta(days=d)) for v, d in (("money_market", 365), ("tbills", 365), ("cash", 365), ("money_market", 0))]
    out = telemetry.parking_yield(spark.createDataFrame(rows, "vehicle string, amount double, entry_date date, as_of date")).collect()
    assert [round(r.current_value, 2) for r in out] == [10500.0, 10450.0, 10000.0, 10000.0]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("A", x) for x in (0.05, 0.2, 0.7, 400.0)], "symbol string, v double")
    got = {r.le: r.n for r in telemetry.bucket_counts(df, "v", telemetry.FILL_LATENCY_EDGES, ["symbol"]).collect()}
    assert got[0.1] == 1 and got[1.0] == 3 and got[300.0] == 3 and got[float("inf")] == 4


def test_allocation_caps_and_does_not_scale_up(spark):
    rows = [(DAY, "A", "LONG", 0.9, 0.10), (DAY, "B", "LONG", 0.5, 0.40), (DAY, "C", "HOLD", 0.9, 0.1), (DAY, "D", "LONG", 0.2, 0.1)]
    got = by_key(portfolio.allocate(spark.createDataFrame(rows, "date date, symbol string, signal string, confidence double, volatility double")), "symbol")
    assert got["weight"][0] == 0.5 and got["weight"].sum() < 1 and got["weight"][2] == got["weight"][3] == 0
    assert got["reason"][2] == "Signal is HOLD" and got["reason"][3].endswith("< 40%")


@pytest.mark.parametrize("tile", [1, 256])
def test_correlation_matrix_matches_pandas(spark, tile):
    pdf = random_bars(("A", "B", "C"), 100)
    pdf["ret"] = pdf.groupby("symbol")["close"].pct_change().fillna(0.0)
    got = portfolio.correlation_matrix(spark.createDataFrame(pdf[["symbol", "date", "ret"]]), 60, tile).toPandas()
    wide = pdf.pivot(index="date", columns="symbol", values="ret").iloc[-60:].corr()
    assert len(got) == 9
    for r in got.itertuples():
        assert r.rho == pytest.approx(wide.loc[r.symbol_a, r.symbol_b])


def test_excluded_asset_has_one_reason(spark):
    pdf = random_bars(("SPY", "TQQQ"), 40)
    bars = spark.createDataFrame(pdf)
    spreads = spark.createDataFrame([("SPY", 2.0)], "symbol string, spread_bps double")
    labels = bars.selectExpr("symbol", "date", "'NEUTRAL' AS regime")
    got = {r.symbol: r for r in portfolio.eligibility(bars, spreads, labels, min_adv=1.0).collect()}
    assert got["SPY"].eligible and got["TQQQ"].rejection_reasons == ["Explicitly excluded (leveraged/decay asset)"]


def test_margin_rules(spark):
    schema = "account_id int, position_type string, underlying_price double, strike double, premium double, contracts int, spread_width double"
    rows = [(1, "long_call", 100.0, 105.0, 2.0, 1, None), (1, "covered_call", 100.0, 105.0, 2.0, 1, None), (1, "short_call", 100.0, 105.0, 2.0, 1, None),
            (1, "iron_condor", 100.0, 95.0, 2.0, 1, 5.0), (1, "other", 100.0, 0.0, 0.0, 1, None)]
    out = margin.margin(spark.createDataFrame(rows, schema))
    assert [r.initial_margin for r in out.collect()] == pytest.approx([200.0, 5000.0, 2200.0, 300.0, 10000.0])
    acc = margin.account_margin(out, 10_000.0).first()
    assert acc.margin_used == pytest.approx(17700.0) and acc.margin_ratio == pytest.approx(1.77)


def test_condor_zones(spark):
    condor = spark.createDataFrame([("A", 100.0, 30, 95.0, 90.0, 105.0, 110.0, 200.0, 300.0, 1)],
                                   "underlying string, underlying_price double, dte int, short_put_strike double, long_put_strike double, short_call_strike double, "
                                   "long_call_strike double, premium_received double, max_loss double, contracts int")
    got = by_key(options.condor_grid(condor, [-0.2, -0.07, 0.0, 0.06, 0.2]), "move")
    assert list(got["pnl"]) == pytest.approx([-300.0, 0.0, 200.0, 100.0, -300.0])
    assert 0 < options.condor_pop(condor, "0.2D").first().probability_of_profit < 1


def test_csv_bars_keep_one_row_per_day(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.csv", "w") as f:
        f.write("symbol,date,open,high,low,close,volume\nA,2023-01-02,1,2,0.5,1.5,10\nA,2023-01-02,3,4,2.5,3.5,30\nA,2023-01-03,1,2,0.5,1.5,10\n")
    got = by_key(bar_sources.read_bars(spark, f"{folder}/a.csv", "csv"), "date")
    assert len(got) == 2 and got["open"][0] == 1.0
    bar_sources.write_artifact(bar_sources.read_bars(spark, f"{folder}/a.csv", "csv"), f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_audit_log_parses_both_ways(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    record = {"timestamp": "2026-01-07T22:07:56.623466+00:00", "decision_id": "D000001", "vol_prob": 0.0002, "signal": "ENTER_LONG", "signal_source": "regime_model",
              "order_qty": None, "notes": "Vol=0, Trend=0"}
    with open(f"{folder}/a.json", "w") as f:
        json.dump([record, {**record, "decision_id": "D000002"}], f, indent=2)
    names = [c.split()[0] for c in logs.AUDIT_SCHEMA.split(", ")]
    with open(f"{folder}/a.csv", "w") as f:
        f.write(",".join(names) + "\n" + ",".join('"Vol=0, Trend=0"' if n == "notes" else str(record.get(n) or "") for n in names) + "\n")
    j = logs.read_log(spark, f"{folder}/a.json", logs.AUDIT_SCHEMA, "json")
    c = logs.read_log(spark, f"{folder}/a.csv", logs.AUDIT_SCHEMA)
    assert logs.audit_by_id(j, "D000002").count() == 1 and logs.audit_recent(j, 1).first().decision_id == "D000002"
    assert c.first().notes == "Vol=0, Trend=0" and c.first().timestamp == j.first().timestamp


def test_both_feeds_count_unless_a_limit_is_asked_for(spark):
    ts = dt.datetime(2023, 1, 2)
    schema = "symbol string, ts timestamp, headline string, source string"
    first = spark.createDataFrame([("A", ts, f"h{i % 60}", "one") for i in range(600)] + [("B", ts, "same", "one")], schema)
    second = spark.createDataFrame([("A", ts, "extra", "two"), ("B", ts, "same", "two"), ("B", ts, "other", "two")], schema)
    assert news_sources.combine_news(first, second).where("symbol = 'A'").count() == 61
    got = news_sources.combine_news(first, second, min_primary=50)
    assert got.where("symbol = 'A'").count() == 60
    assert sorted((r.headline, r.source) for r in got.where("symbol = 'B'").collect()) == [("other", "two"), ("same", "one")]


@pytest.fixture(scope="module")
def hot_events():
    """One account holds a third of all rows."""
    rng = np.random.default_rng(3)
    n = 3000
    base = pd.Timestamp("2024-01-01")
    pdf = pd.DataFrame({
        "account_id": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 40, n)), "event_id": np.arange(n),
        "ts": base + pd.to_timedelta(np.sort(rng.integers(0, 5 * 86400, n)), unit="s"), "value": rng.integers(0, 100, n).astype(float),
        "bad": rng.random(n) < 0.6,
    })
    return pdf


BUCKET = "CAST(unix_seconds(ts) DIV 3600 AS BIGINT)"


def test_bucketed_running_sum(spark, hot_events):
    got = by_key(scan.running_sum(spark.createDataFrame(hot_events), ["account_id"], BUCKET, ["ts", "event_id"], "value", "total"), "event_id")
    expected = hot_events.groupby("account_id")["value"].cumsum()
    np.testing.assert_allclose(got["total"], expected)


def test_bucketed_run_length(spark, hot_events):
    got = by_key(scan.run_length(spark.createDataFrame(hot_events), ["account_id"], BUCKET, ["ts", "event_id"], "bad", "run"), "event_id")
    run, expected = {}, []
    for r in hot_events.itertuples():
        run[r.account_id] = run.get(r.account_id, 0) + 1 if r.bad else 0
        expected.append(run[r.account_id])
    assert list(got["run"]) == expected


def test_trailing_count(spark, hot_events):
    got = by_key(scan.trailing_count(spark.createDataFrame(hot_events), ["account_id"], "ts", 600, "n"), "event_id")
    assert len(got) == len(hot_events)
    for r in got.itertuples():
        same = hot_events[hot_events["account_id"] == r.account_id]
        age = (r.ts - same["ts"]).dt.total_seconds()
        assert r.n == ((age >= 0) & (age < 600)).sum()
