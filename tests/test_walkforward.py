"""Bucket sums, sliding quantiles, refits and pooled fits against fits on copied rows and against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.sliding import span_quantiles
from barloom.operators import align, leakage, moments, pooled, specialists, windows
from barloom.plans import stage
from tests.helpers import by_key

X = ["a", "b"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    frames = []
    for s in ("A", "B", "C"):
        days = np.flatnonzero(rng.random(500) < 0.7)
        n = len(days)
        a = rng.normal(0, 1, n)
        frames.append(pd.DataFrame({
            "symbol": s, "date": [dt.date(2020, 1, 1) + dt.timedelta(days=int(d)) for d in days], "a": a.round(1), "b": 50 + rng.normal(0, 3, n),
            "flat": 7.25, "actual_direction": np.sign(a + rng.normal(0, 2, n)).astype(int), "actual_return": rng.normal(0, 0.01, n)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, pdf):
    df = spark.createDataFrame(pdf)
    return moments.with_bucket(df, df.groupBy("symbol").agg(F.expr("min(date) AS first_date")), 20).cache()


@pytest.fixture(scope="module")
def wins(rows):
    return windows.windows_calendar(rows, 120, 20, 10)


def test_windows_count_their_rows(pdf, wins):
    got = by_key(wins, "symbol", "window_id")
    assert len(got) > 30
    for w in got.itertuples():
        own = pdf[pdf.symbol == w.symbol]
        assert w.train_rows == ((own.date >= w.train_start) & (own.date < w.test_start)).sum() >= 10
        assert w.test_rows == ((own.date >= w.test_start) & (own.date < w.test_end)).sum() > 0


@pytest.mark.parametrize("train, test", [(120, 20), (100, 40)])
def test_window_sums_equal_sums_of_copied_rows(pdf, spark, train, test):
    df = spark.createDataFrame(pdf)
    wins = windows.windows_calendar(df, train, test, 10)
    bucketed = moments.with_bucket(df, df.groupBy("symbol").agg(F.expr("min(date) AS first_date")), moments.bucket_days(train, test))
    sums = moments.window_moments(bucketed, wins, [*X, "flat"], ["actual_direction"], train, test, {"b": 50.0})
    got = by_key(sums.selectExpr("symbol", "window_id", "_n", *[f"{moments.correlation(c, 'actual_direction')} AS r_{c}" for c in [*X, "flat"]]), "symbol", "window_id")
    copied = align.assign_windows(df, wins, test, train)
    for w in got.itertuples():
        own = copied.where(f"symbol = '{w.symbol}' AND window_id = {w.window_id} AND role = 'train'").toPandas() if w.window_id % 5 == 1 else None
        if own is not None:
            assert w.r_a == pytest.approx(own["a"].corr(own["actual_direction"]), abs=1e-10)
            assert w.r_b == pytest.approx(own["b"].corr(own["actual_direction"]), abs=1e-10)
    assert got["r_flat"].isna().all()
    tested = by_key(moments.test_rows(bucketed, wins, train, test).select("symbol", "date", "window_id"), "symbol", "date")
    expected = by_key(copied.where("role = 'test'").select("symbol", "date", F.col("window_id").cast("long").alias("window_id")), "symbol", "date")
    pd.testing.assert_frame_equal(tested, expected)


def test_span_quantiles_equal_quantiles_of_copied_rows(spark, pdf, rows, wins):
    got = span_quantiles(rows, {"a": (0.2, 0.8), "b": (0.6,)}, 6, 1).join(wins.select("symbol", "window_id"), ["symbol", "window_id"])
    copied = align.assign_windows(rows.drop("bucket"), wins, 20, 120).where("role = 'train'")
    expected = copied.groupBy("symbol", "window_id").agg(F.expr("percentile(a, 0.2) AS _q0_a"), F.expr("percentile(a, 0.8) AS _q1_a"), F.expr("percentile(b, 0.6) AS _q0_b"))
    pd.testing.assert_frame_equal(by_key(got, "symbol", "window_id"), by_key(expected, "symbol", "window_id"), check_dtype=False)


def test_walk_forward_fits_equal_fits_on_copied_rows(rows, wins):
    named = rows.selectExpr("*", "a * b AS c", "b - a AS d", "a + 1 AS m")
    family = {"momentum": ["a", "c"], "rsi": ["b"], "ma": ["m", "d"]}
    by = ["symbol", "window_id"]
    got = specialists.walk_forward_fits(named, wins, "actual_direction", 120, 20, **family, news=["a"])
    train = align.assign_windows(named.drop("bucket"), wins, 20, 120).where("role = 'train'")
    expected = specialists.fit_rules(train, "actual_direction", by, **family).join(specialists.fit_sentiment(train, "actual_direction", by, ["a"]), by)
    cols = sorted(set(expected.columns) - set(by))
    pd.testing.assert_frame_equal(by_key(got.select(*by, *cols), *by), by_key(expected.select(*by, *cols), *by), check_dtype=False)


def test_refit_sees_the_labels_it_is_given(spark, rows, wins):
    """A feature that copies the label of the bar before: only the fit on labels moved by one finds it."""
    leaky = rows.selectExpr("symbol", "date", "bucket", "actual_direction", "actual_return", "coalesce(lag(actual_direction) OVER (PARTITION BY symbol ORDER BY date), 0) * 1D AS leak")
    moved = {r.variant: r for r in leakage.refit_time_shift(leaky, wins, [-1, 1], features=["leak"], train_days=120, test_days=20).where("symbol = 'A'").collect()}
    assert moved["early_1"].directional_accuracy > 0.99 > 0.75 > moved["late_0"].directional_accuracy
    copies = rows.selectExpr("symbol", "date", "bucket", "actual_direction", "actual_return", "actual_direction * 1D AS leak")
    dealt = {r.variant: r for r in leakage.refit_label_shuffle(copies, wins, [1, 2], features=["leak"], train_days=120, test_days=20).where("symbol = 'A'").collect()}
    assert set(dealt) == {"true", "shuffle_1", "shuffle_2"}
    assert dealt["true"].directional_accuracy == 1 and not dealt["true"].passed
    labels = leakage.shuffle_labels(copies, [1]).where("symbol = 'B'").toPandas()
    assert sorted(labels.y_shuffle_1) == sorted(labels.actual_direction) and (labels.y_shuffle_1 != labels.actual_direction).any()


def test_exact_quantiles_of_a_pool(spark):
    rng = np.random.default_rng(2)
    values = pd.DataFrame({"x": np.concatenate([rng.normal(0, 1, 3000), np.full(2000, 0.5), [1e300, -1e300, 1e-300, 0.0]]), "t": rng.integers(0, 3, 5004).astype(float)})
    values["n"] = values["x"].where(rng.random(5004) < 0.9)
    df = spark.createDataFrame(values.astype(object).where(values.notna(), None), "x double, t double, n double")
    cuts = {"x": (0.0, 0.2, 0.5, 0.813, 1.0), "t": (0.6,), "n": (0.25, 0.75)}
    for bins in (4, 1024):
        got = pooled.exact_quantiles(df, cuts, bins)
        for c, qs in cuts.items():
            np.testing.assert_allclose(got[c], np.quantile(values[c].dropna(), qs), rtol=1e-12)
    assert pooled.exact_quantiles(df.limit(0), {"x": (0.5,)}) == {"x": [None]}
    assert pooled.exact_quantiles(df.selectExpr("CAST(NULL AS DOUBLE) AS x", "t"), {"x": (0.5,), "t": (1.0,)}) == {"x": [None], "t": [2.0]}


@pytest.mark.parametrize("name", ["walk_forward_backtest", "refit_time_shift_test", "refit_label_shuffle_test", "cross_symbol_transfer", "component_ablation", "average_ensemble",
                                  "path_survival", "path_results", "portfolio_stress", "stress_summary", "falsification_verdict"])
def test_bars_are_scanned_once(spark, monkeypatch, name):
    """All reads of lineitem, those of the stages included, by counting them in every plan that is written or returned."""
    from barloom.operators import ensemble
    from workloads import catalog, q_falsify, q_models, views

    seen = []

    def counting(df, stage_name):
        seen.append(count_scans(df))
        return stage.staged(df, stage_name)

    for module in (views, q_models, q_falsify, ensemble):
        monkeypatch.setattr(module, "staged", counting)
    out = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sum(seen) + count_scans(out) <= 2


def count_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("l_shipdate" in line for line in plan.splitlines() if "FileScan parquet" in line or "Scan parquet" in line)


def test_stages_are_dropped(spark, rows):
    frame = stage.staged(rows.select("symbol", "date"), "probe")
    assert frame.count() == rows.count()
    path = frame.inputFiles()[0].rsplit("/", 1)[0]
    assert stage.drop_stages(spark) >= 1
    where, files = stage._hadoop(spark, path)
    assert not files.exists(where)


def test_permutation_importance_finds_the_feature_that_counts(spark):
    from barloom.operators import trees

    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"symbol": np.repeat(["A", "B"], 200), "date": [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in range(200)] * 2,
                          "good": rng.normal(0, 1, 400), "noise": rng.normal(0, 1, 400)})
    frame["y"] = (frame.good > 0).astype(int)
    df = spark.createDataFrame(frame)
    model = trees.fit_forest(df, ["good", "noise"], "y", 10)
    got = {r.feature: r for r in trees.permutation_importance(model, df, ["good", "noise"], "y").collect()}
    assert got["good"].n_rows == got["noise"].n_rows == 400
    assert got["good"]["drop"] > 0.3 > 0.05 > got["noise"]["drop"]
    held = trees._holdout(df, 0.2, 1, "y").where("is_validation").groupBy("y").count().toPandas().set_index("y")["count"]
    for label, size in frame.y.value_counts().items():
        assert abs(held[label] - 0.2 * size) <= 1
