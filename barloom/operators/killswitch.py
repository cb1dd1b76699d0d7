"""Batch form of the kill-switch monitor; the streaming form is in ``barloom.streaming.killswitch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import KILL_SWITCH, KillSwitchLimits
from barloom.functions.scan import run_length

ORDER = ["ts", "event_id"]


def kill_switch(events: DataFrame, limits: KillSwitchLimits = KILL_SWITCH, bucket: str = "CAST(unix_seconds(ts) DIV 3600 AS BIGINT)") -> DataFrame:
    """Action per account event, checks in order: daily loss, confidence, API errors, slippage, position.

    A row stopped by one of the first two checks never reaches the API counter. A halt latches: every later
    row of the account is 'halt' without a new check. The first equity of a day is that day's start.
    Accounts may be of any size: day starts and first halts are aggregates, and the run of API errors is a
    bucketed scan.
    """
    starts = events.selectExpr("account_id", "to_date(ts) AS _day", "ts", "event_id", "equity").groupBy("account_id", "_day").agg(
        F.expr("min_by(equity, struct(ts, event_id)) AS _start")
    )
    df = events.selectExpr("*", "to_date(ts) AS _day").join(starts, ["account_id", "_day"])
    df = df.selectExpr("* EXCEPT (_day, _start)", "coalesce(try_divide(equity - _start, _start), 0D) * 100 AS daily_pnl_pct")
    df = df.selectExpr(
        "*", f"CASE WHEN daily_pnl_pct < {-limits.max_daily_loss_pct!r}D THEN 'daily_loss' "
        f"WHEN confidence < {limits.min_confidence!r}D THEN 'confidence_collapse' END AS _early",
    )
    late = run_length(df.where("_early IS NULL"), ["account_id"], bucket, ORDER, "NOT api_success", "_errors")
    late = late.selectExpr(
        "*",
        f"CASE WHEN _errors >= {limits.max_api_errors} THEN 'api_error' WHEN abs(slippage_bps) > {limits.max_slippage_bps!r}D THEN 'slippage_breach' "
        "WHEN abs(position - expected_position) > greatest(1D, abs(expected_position) * 0.05D) THEN 'unexpected_position' END AS switch_type",
    ).drop("_errors", "_early")
    early = df.where("_early IS NOT NULL").withColumnRenamed("_early", "switch_type")
    checked = late.unionByName(early)
    halts = checked.where("switch_type IN ('api_error', 'slippage_breach')").groupBy("account_id").agg(
        F.expr("min(struct(ts, event_id)) AS _halt")
    )
    out = checked.join(halts, "account_id", "left").selectExpr(
        "* EXCEPT (_halt)", "coalesce(struct(ts, event_id) > _halt, false) AS halted"
    )
    return out.selectExpr(
        "* EXCEPT (switch_type)", "IF(halted, NULL, switch_type) AS switch_type",
        "CASE WHEN halted OR switch_type IN ('api_error', 'slippage_breach') THEN 'halt' WHEN switch_type IS NOT NULL THEN 'flatten' ELSE 'none' END AS action",
        "halted OR switch_type IS NOT NULL AS triggered",
    )


def kill_switch_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("account_id").agg(
        F.expr("count(*) AS events"), F.expr("count_if(triggered) AS triggered"), F.expr("count_if(action = 'flatten') AS flattened"),
        F.expr("min(IF(action = 'halt', ts, NULL)) AS halted_at"),
    )
