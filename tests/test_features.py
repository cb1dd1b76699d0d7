"""Features against pandas on random bars, golden targets and news alignment, and the no-look-ahead rule."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling as R, sliding
from barloom.operators import align, market, news, price, quality, regimes
from tests.helpers import by_key, random_bars


def safe(a, b):
    return (a / b.replace(0, np.nan)).fillna(0)


def pandas_features(df):
    out = df.copy()
    c = df["close"]
    out["return_5d"] = c.pct_change(5)
    ret = c.pct_change()
    out["volatility_20d"] = ret.rolling(20).std()
    out["vol_term_structure"] = safe(ret.rolling(5).std(), ret.rolling(60).std())
    ma = c.rolling(20).mean()
    out["ma_20_slope"] = ma.diff(5) / ma.shift(5)
    delta = c.diff()
    gain, loss = delta.where(delta > 0, 0).rolling(14).mean(), (-delta.where(delta < 0, 0)).rolling(14).mean()
    out["rsi_14"] = 100 - 100 / (1 + safe(gain, loss))
    tr = pd.concat([df["high"] - df["low"], (df["high"] - c.shift()).abs(), (df["low"] - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_14"] = tr.rolling(14).mean()
    amihud = safe(ret.abs(), c * df["volume"]).rolling(20).mean() * 1e6
    out["amihud_illiquidity"] = amihud
    out["amihud_rel_60"] = safe(amihud, amihud.rolling(60).mean())
    out["vol_ret_corr_20"] = df["volume"].rolling(20).corr(ret.abs())
    return out


@pytest.fixture(scope="module")
def pdf():
    return random_bars()


@pytest.fixture(scope="module")
def features(spark, pdf):
    return price.price_features(spark.createDataFrame(pdf)).cache()


def test_price_features_match_pandas(features, pdf):
    expected = pd.concat([pandas_features(g) for _, g in pdf.groupby("symbol")]).reset_index(drop=True)
    got = by_key(features, "symbol", "date")
    for column in ["return_5d", "volatility_20d", "vol_term_structure", "ma_20_slope", "rsi_14", "atr_14", "amihud_illiquidity",
                   "amihud_rel_60", "vol_ret_corr_20"]:
        np.testing.assert_allclose(got[column].astype(float), expected[column].astype(float), rtol=1e-8, atol=1e-10, err_msg=column)


def test_features_do_not_look_ahead(spark, features, pdf):
    cut = dt.date(2020, 9, 1)
    early = price.price_features(spark.createDataFrame(pdf[pdf["date"] <= cut]))
    a, b = by_key(early, "symbol", "date"), by_key(features.where(f"date <= DATE '{cut}'"), "symbol", "date")
    pd.testing.assert_frame_equal(a, b)


def test_build_needs_one_shuffle(features, spark, pdf):
    bars = spark.createDataFrame(pdf).repartition(4, "symbol")
    plan = price.price_features(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rolling_quantile_matches_pandas(spark, pdf):
    pdf = pdf.assign(volume=pdf["volume"].where(pdf.index % 37 != 5).round(-2))  # gaps and ties
    specs = {"q": ("volume", 0.75), "m": ("volume", 0.5), "c": ("close", 0.1)}
    plain = sliding.rolling_quantiles(spark.createDataFrame(pdf.astype({"volume": object}).where(pdf.notna(), None)).withColumn("volume", F.col("volume").cast("double")), specs, 30)
    got = by_key(plain, "symbol", "date")
    for out, (column, q) in specs.items():
        expected = pdf.groupby("symbol")[column].transform(lambda s: s.rolling(30).quantile(q))
        np.testing.assert_allclose(got[out].astype(float), expected)
    filled = by_key(sliding.rolling_quantiles(plain.select("symbol", "date", "volume"), {"q": specs["q"]}, 30, fill_back=True), "symbol", "date")
    np.testing.assert_allclose(filled["q"].astype(float), got.groupby("symbol")["q"].transform(lambda s: s.astype(float).bfill()))
    assert sliding.rolling_quantiles(plain.limit(0), {"z": specs["q"]}, 30).count() == 0


def test_target_on_a_ten_percent_ramp(spark):
    rows = [("A", dt.date(2023, 1, 1) + dt.timedelta(days=i), 100 * 1.1**i) for i in range(10)]
    df = news.target_open_to_open(spark.createDataFrame(rows, "symbol string, date date, open double"))
    got = by_key(df, "date")["next_day_return"]
    assert got[0] == pytest.approx(0.10)
    assert got.isna().sum() == 2


def test_news_is_delayed_one_bar(spark):
    days = [dt.date(2023, 1, d) for d in (2, 3, 4)]
    bars = spark.createDataFrame([("A", d, 100.0 + i, 0.01) for i, d in enumerate(days)], "symbol string, date date, close double, return_1d double")
    items = spark.createDataFrame(
        [("A", dt.datetime(2023, 1, 2, 10), "shares rally"), ("A", dt.datetime(2023, 1, 2, 18), "profit warning"), ("A", dt.datetime(2023, 1, 3, 9), "flat")],
        "symbol string, ts timestamp, headline string")
    got = by_key(news.news_features(bars, items), "date")
    assert list(got["news_count_1d"]) == [0, 2, 1]


def test_no_news_gives_zeros(spark, pdf):
    empty = spark.createDataFrame([], "symbol string, ts timestamp, headline string")
    got = by_key(news.news_features(price.daily_returns(spark.createDataFrame(pdf)), empty), "symbol", "date")
    assert (got["news_count_14d"] == 0).all() and (got["news_sentiment_7d"] == 0).all()


def test_divergence_after_good_news_and_a_fall(spark):
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    closes = [100.0 + (i % 3) * 0.1 for i in range(24)] + [95.0] + [95.1] * 5
    bars = spark.createDataFrame([("A", d, c) for d, c in zip(days, closes)], "symbol string, date date, close double")
    items = spark.createDataFrame([("A", dt.datetime(2023, 1, 25, 12), "strong growth, profit beat")], "symbol string, ts timestamp, headline string")
    got = by_key(news.news_features(price.daily_returns(bars), items), "date")
    assert got["news_price_divergence"][25] > 0.5


def test_substring_sentiment_on_whole_text(spark):
    text = "x" * 50_000 + " group decline"
    df = news.headline_sentiment(spark.createDataFrame([(text,), (None,), ("nothing here",)], "headline string"))
    assert [r.sentiment for r in df.collect()] == pytest.approx([0.0, 0.0, 0.0])
    df = news.headline_sentiment(spark.createDataFrame([("a group gain",)], "headline string"))
    assert df.first().sentiment == pytest.approx(2 / 3)


def test_market_features_match_pandas(spark, pdf):
    bars = spark.createDataFrame(pdf)
    index = pdf[(pdf["symbol"] == "A") & (pdf["close"] > pdf["close"].median())][["date", "close"]]
    got = by_key(market.market_features(price.daily_returns(bars), spark.createDataFrame(index)).where("symbol = 'B'"), "date")
    b = pdf[pdf["symbol"] == "B"].set_index("date")
    aligned = index.set_index("date").reindex(b.index, method="ffill")["close"]
    ir, sr = aligned.pct_change(), b["close"].pct_change()
    beta = sr.rolling(20).corr(ir) * sr.rolling(20).std() / ir.rolling(20).std()
    np.testing.assert_allclose(got["index_return_5d"].astype(float), aligned.pct_change(5).values)
    mask = np.isfinite(beta.values) & got["beta_approx_20"].notna().values
    assert mask.sum() > 50
    np.testing.assert_allclose(got["beta_approx_20"].astype(float)[mask], beta.values[mask], rtol=1e-6, atol=1e-9)


def test_final_features_drop_rows_without_target(spark, pdf):
    df = news.target_open_to_open(price.price_features(spark.createDataFrame(pdf)))
    assert quality.finalize_features(df).count() == len(pdf) - 4
    legacy = quality.finalize_features(df, legacy_fill=True)
    assert legacy.count() == len(pdf) and legacy.where("next_day_return IS NULL").count() == 0
    assert "next_day_return" not in quality.feature_columns(df)


def test_label_shapes(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(320)]
    rng = np.random.default_rng(42)
    close = 100 * np.cumprod(1 + rng.normal(0, 0.002, 320))
    close[270:310] = close[269] * 1.01 ** np.arange(1, 41)
    bars = pd.DataFrame({"symbol": "A", "date": days, "open": close, "high": close * 1.001, "low": close * 0.999, "close": close, "volume": 3000.0})
    bars.loc[15, "low"] = 80.0
    labels = by_key(regimes.label_regimes(spark.createDataFrame(bars)), "date")
    assert labels["regime_vol"][10] == 1
    assert labels["regime_trend"][295] == 1


def test_lattice_puts_safety_first(spark):
    df = regimes.lattice(spark.createDataFrame([(1, 1, 0), (0, 1, 1), (0, 1, 0), (0, 0, 0)], "regime_vol int, regime_trend int, regime_liq int"))
    assert [r.state_name for r in df.collect()] == ["HOSTILE", "HOSTILE", "FAVORABLE", "NEUTRAL"]


def test_info_label_on_steady_drift(spark):
    rows = [("A", dt.date(2023, 1, 1) + dt.timedelta(days=i), 100 * 1.01**i) for i in range(30)]
    got = by_key(regimes.info_label(spark.createDataFrame(rows, "symbol string, date date, close double")), "date")
    assert got["regime_info"][10] == 1


def test_alignment_fill_and_union(spark):
    a = spark.createDataFrame([("A", dt.date(2023, 1, 1), 1.0), ("A", dt.date(2023, 1, 2), 2.0)], "symbol string, date date, x double")
    b = spark.createDataFrame([("A", dt.date(2023, 1, 1), "HOSTILE")], "symbol string, date date, regime string")
    assert align.align([a, b]).count() == 1
    assert [r.regime for r in align.align_left(a, b, {"regime": "UNKNOWN"}).orderBy("date").collect()] == ["HOSTILE", "UNKNOWN"]
    c = spark.createDataFrame([("B", dt.date(2023, 1, 1), 5.0)], "symbol string, date date, y double")
    assert align.union_features([a, c]).where("symbol = 'B'").first().x == 0.0


def test_missing_column_is_reported(spark, pdf):
    with pytest.raises(ValueError):
        quality.validate(spark.createDataFrame(pdf), ["close", "vwap"])
