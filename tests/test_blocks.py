"""Long series cut into blocks and buckets give what one window per series gives."""

import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import scan
from barloom.operators import price


@pytest.fixture(scope="module")
def bars(spark):
    days = spark.range(700).selectExpr("id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS date")
    rows = days.crossJoin(spark.createDataFrame([("A", 700), ("B", 233), ("C", 1)], "symbol string, n int")).where("id < n")
    draw = "(pmod(xxhash64(symbol, id, {}), 1000) / 1000D)"
    rows = rows.selectExpr("symbol", "date", f"100 + 10 * sin(id / 9D) + {draw.format(1)} AS close", f"CAST(1000 + 500 * {draw.format(2)} AS DOUBLE) AS volume")
    return rows.selectExpr("*", "close * 0.99D AS open", "close * 1.02D AS high", "close * 0.97D AS low").cache()


def _rows(df, columns):
    return {(r.symbol, r.date): [r[c] for c in columns] for r in df.select("symbol", "date", *columns).collect()}


def test_price_features_in_blocks(bars):
    plain = price.price_features(bars)
    cut = scan.in_blocks(bars, "symbol", "month(date)  + 12 * year(date)", ["date"], 300, price.LOOK_BACK, price.price_features)
    assert set(cut.columns) == set(plain.columns)
    columns = [c for c in plain.columns if c not in ("symbol", "date")]
    a, b = _rows(plain, columns), _rows(cut, columns)
    assert a.keys() == b.keys() and len(a) == 934
    for k, values in a.items():
        for c, x, y in zip(columns, values, b[k]):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (k, c, x, y)


def test_halo_longer_than_block(bars):
    with pytest.raises(ValueError):
        scan.in_blocks(bars, "symbol", "year(date)", ["date"], 10, 11, price.price_features)


@pytest.mark.parametrize("start", [None, 1.0])
def test_drawdown_by_bucket(bars, start):
    returns = bars.selectExpr("symbol", "date", "IF(day(date) = 7, NULL, (volume - 1250) / 5000) AS r")
    got = _rows(scan.drawdown(returns, ["symbol"], "date_trunc('MONTH', date)", ["date"], "r", start=start), ["equity", "drawdown"])
    by_symbol = returns.orderBy("symbol", "date").collect()
    value, peak, symbol = 1.0, -1.0, None
    for r in by_symbol:
        if r.symbol != symbol:
            value, peak, symbol = 1.0, -1.0 if start is None else start, r.symbol
        value *= 1 + (r.r or 0.0)
        peak = max(peak, value)
        assert math.isclose(got[r.symbol, r.date][0], value, rel_tol=1e-9)
        assert math.isclose(got[r.symbol, r.date][1], value / peak - 1, rel_tol=1e-9, abs_tol=1e-12)
    assert len(got) == len(by_symbol)
