"""Each stream monitor against its batch twin."""

import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.killswitch import kill_switch
from barloom.streaming import monitors
from barloom.streaming.killswitch import kill_switch_stream
from barloom.streaming.sinks import write_audit
from tests.helpers import by_key


def as_stream(spark, df, order=None, files=1):
    """Write ``df`` as files in time order and read them back as a stream of one file per batch."""
    folder = tempfile.mkdtemp(prefix="spark-")
    if files == 1:
        df.coalesce(1).write.mode("append").parquet(folder)
    else:
        for k in range(files):
            df.withColumn("_k", F.ntile(files).over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)).orderBy(order))).where(
                f"_k = {k + 1}").drop("_k").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, mode="append"):
    spark = stream.sparkSession
    folder = tempfile.mkdtemp(prefix="spark-")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


KS_COLS = ["account_id", "event_id", "ts", "switch_type", "action", "triggered", "halted"]
KS_SCHEMA = "account_id long, event_id long, ts timestamp, equity double, confidence double, slippage_bps double, position double, expected_position double, api_success boolean"


def account_rows(n, accounts, seed, step_s=40):
    """Events of a hot account, with two thirds of the rows, and some others; calm enough that halts come late."""
    rng = np.random.default_rng(seed)
    t0 = dt.datetime(2024, 1, 1, 20)
    rows = []
    for i in range(n):
        account = 0 if rng.random() < 0.67 else int(rng.integers(1, accounts))
        slip = 400.0 if account == 1 and i > n // 2 else float(rng.normal(0, 2))
        rows.append((account, i, t0 + dt.timedelta(seconds=step_s * (i // 2)), float(1000 + rng.normal(0, 6)), float(rng.uniform(0.55, 1) if account != 2 else rng.uniform(0, 1)),
                     slip, float(rng.integers(-2, 3)), 0.0, bool(rng.random() < (0.4 if account == 3 else 0.97))))
    return rows


def feed_files(spark, files, schema):
    folder = tempfile.mkdtemp(prefix="spark-")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_kill_switch_stream_takes_late_files(spark):
    """Files out of order, one account with most rows: the same rows as the batch form."""
    rows = account_rows(900, 6, 3)
    parts = [rows[k:k + 150] for k in range(0, 900, 150)]
    files = [parts[1][::-1], parts[0], parts[3], parts[2], parts[5][1::2] + parts[4][::2], parts[4][1::2] + parts[5][::2]]
    sentinel = [(99, 10_000 + k, dt.datetime(2024, 3, 1 + k), 1.0, 0.9, 0.0, 0.0, 0.0, True) for k in range(2)]
    stream = feed_files(spark, [*files, sentinel[:1], sentinel[1:]], KS_SCHEMA)
    got = by_key(run(kill_switch_stream(stream, delay="3 hours"), "ks").where("account_id < 99").select(*KS_COLS), "event_id")
    expected = by_key(kill_switch(spark.createDataFrame(rows, KS_SCHEMA)).select(*KS_COLS), "event_id")
    pd.testing.assert_frame_equal(got, expected)
    assert (expected["action"] == "halt").any() and {"api_error", "slippage_breach", "confidence_collapse"} <= set(expected["switch_type"].dropna())


def test_kill_switch_stream_equals_batch(spark, inputs):
    events = inputs.account_events
    last = events.agg(F.max("ts")).first()[0] + dt.timedelta(days=20)
    ends = spark.createDataFrame([(-1, -k, last + dt.timedelta(days=k), 1.0, 0.9, 0.0, 0.0, 0.0, True) for k in (1, 2)], KS_SCHEMA)
    columns = [c.split()[0] for c in KS_SCHEMA.split(", ")]
    both = events.select(*columns).unionByName(ends.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in events.select(*columns).schema]))
    got = by_key(run(kill_switch_stream(as_stream(spark, both, "ts", 3)), "ks2").where("account_id >= 0").select(*KS_COLS), "event_id")
    pd.testing.assert_frame_equal(got, by_key(kill_switch(events).select(*KS_COLS), "event_id"))


def test_kill_switch_advances_by_parts(spark):
    """Any split of a series into parts gives the rows and state of the whole."""
    from barloom.streaming.killswitch import START, advance

    rows = pd.DataFrame(account_rows(400, 2, 8, 900), columns=[c.split()[0] for c in KS_SCHEMA.split(", ")])
    whole_state, whole = advance(START, rows)
    for size in (1, 7, 133):
        state, parts = START, []
        for k in range(0, len(rows), size):
            state, out = advance(state, rows[k:k + size])
            parts.append(out)
        assert state == whole_state
        pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)


def test_kill_switch_order_of_checks(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [
        (1, 0, 100.0, 0.9, 0.0, 0.0, 0.0, True), (1, 1, 96.0, 0.1, 99.0, 0.0, 9.0, False), (1, 2, 100.0, 0.1, 99.0, 0.0, 9.0, False),
        (1, 3, 100.0, 0.9, 0.0, 0.0, 9.0, False), (1, 4, 100.0, 0.9, 0.0, 0.0, 0.0, False), (1, 5, 100.0, 0.9, 0.0, 0.0, 0.0, False),
        (1, 6, 100.0, 0.9, 0.0, 0.0, 0.0, True), (2, 7, 100.0, 0.9, -15.5, 0.0, 0.0, True),
    ]
    df = spark.createDataFrame([(a, i, t0 + dt.timedelta(minutes=i), *rest) for a, i, *rest in rows],
                               "account_id long, event_id long, ts timestamp, equity double, confidence double, slippage_bps double, position double, expected_position double, api_success boolean")
    got = by_key(kill_switch(df), "event_id")
    assert list(got["action"]) == ["none", "flatten", "flatten", "flatten", "none", "halt", "halt", "halt"]
    assert list(got["switch_type"]) == [None, "daily_loss", "confidence_collapse", "unexpected_position", None, "api_error", None, "slippage_breach"]


def test_signals_are_deduplicated(spark, inputs):
    got = run(monitors.dedupe_signals(as_stream(spark, inputs.signals, "ts", 2), "40 days"), "dd")
    ids = {tuple(r) for r in got.select(*monitors.SIGNAL_KEY).collect()}
    assert got.count() == len(ids) == monitors.dedupe_signals(inputs.signals).count()


def test_fill_monitor_stream(spark, inputs):
    got = by_key(run(monitors.fill_monitor(as_stream(spark, inputs.fills), delay="0 seconds"), "fm", "complete"), "day")
    pd.testing.assert_frame_equal(got, by_key(monitors.fill_monitor(inputs.fills), "day"), check_exact=False)


def test_signal_counts_and_rate_windows_stream(spark, inputs):
    got = by_key(run(monitors.signal_counts(as_stream(spark, inputs.signals)), "sc", "complete"), "day", "signal")
    pd.testing.assert_frame_equal(got, by_key(monitors.signal_counts(inputs.signals), "day", "signal"))
    got = run(monitors.rate_windows(as_stream(spark, inputs.account_events), 0), "rw", "complete")
    assert got.count() == monitors.rate_windows(inputs.account_events, 0).count()


def test_late_rows_are_dropped(spark):
    schema = "ts timestamp, signal string"
    early = spark.createDataFrame([(dt.datetime(2024, 1, 10), "HOLD")], schema)
    folder = tempfile.mkdtemp(prefix="spark-")
    early.coalesce(1).write.parquet(folder, mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")

    def drain():
        q = write_audit(monitors.signal_counts(stream), out, checkpoint, available_now=True)
        q.awaitTermination(240)

    drain()
    for row in ((dt.datetime(2024, 1, 1), "HOLD"), (dt.datetime(2024, 1, 20), "HOLD"), (dt.datetime(2024, 2, 20), "HOLD")):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(folder, mode="append")
        drain()
    days = {str(r.day) for r in spark.read.parquet(out).collect()}
    assert "2024-01-10" in days and "2024-01-01" not in days


def test_decision_join_stream(spark):
    schema = "symbol string, ts timestamp, action string, price double"
    t = dt.datetime(2024, 1, 2, 22)
    expected = spark.createDataFrame([("A", t, "HOLD", 1.0), ("B", t, "ENTER_LONG", 1.0)], schema)
    actual = spark.createDataFrame([("A", t + dt.timedelta(hours=5), "HOLD", 1.0), ("B", t + dt.timedelta(hours=25), "HOLD", 1.0)], schema)
    got = run(monitors.recon_stream(as_stream(spark, expected), as_stream(spark, actual)), "rs")
    assert [(r.symbol, r.is_aligned) for r in got.collect()] == [("A", True)]
    assert monitors.recon_stream(expected, actual).count() == 1


def test_audit_sink_is_append_only(spark, inputs):
    folder, checkpoint = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    stream = as_stream(spark, inputs.signals)
    for _ in range(2):
        write_audit(stream, folder, checkpoint, available_now=True).awaitTermination(240)
    assert spark.read.parquet(folder).count() == inputs.signals.count()
