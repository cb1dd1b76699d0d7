"""The as-of join by buckets against a plain search."""

import datetime as dt
import random

import pytest

from barloom.operators.align import asof_join, carry_forward

START = dt.date(1995, 1, 1)


def _day(n):
    return START + dt.timedelta(days=n)


def _plain(bars, index):
    best = {}
    for date, v in index:
        if v is not None:
            best[date] = max(v, best.get(date, v))
    return sorted((s, d, best[max(k for k in best if k <= d)] if any(k <= d for k in best) else None) for s, d in bars)


@pytest.mark.parametrize("width", [1, 7, 32])
def test_asof_equals_search(spark, width):
    r = random.Random(width)
    # long gaps, no values, several values of a day; bars before the first and long after the last
    index = [(_day(r.choice((0, 900, 905, 2500)) + r.randrange(60)), r.choice((None, r.random()))) for _ in range(80)]
    bars = [(s, _day(r.randrange(-400, 4000))) for s in "ab" for _ in range(150)]
    got = asof_join(spark.createDataFrame(bars, "symbol string, date date"), spark.createDataFrame(index, "date date, close double"), width=width)
    assert got.columns == ["symbol", "date", "index_close"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain(bars, index), key=repr)


def test_asof_without_benchmark_or_bars(spark):
    bars = spark.createDataFrame([("a", START)], "symbol string, date date")
    index = spark.createDataFrame([(START, None)], "date date, close double")
    assert asof_join(bars, index).collect()[0].index_close is None
    one = spark.createDataFrame([(START, 2.0)], "date date, close double")
    assert asof_join(bars, one).collect()[0].index_close == 2.0
    assert asof_join(bars.limit(0), one).count() == 0


def test_carry_looks_strictly_back(spark):
    buckets = spark.range(5, 30).selectExpr("id AS _bucket")
    ends = spark.createDataFrame([(5, 1.0), (9, 2.0), (22, 3.0)], "_bucket long, _last double")
    got = {x._bucket: x._carry for x in carry_forward(buckets, ends, 5, 29).collect()}
    assert got == {k: None if k <= 5 else 1.0 if k <= 9 else 2.0 if k <= 22 else 3.0 for k in range(5, 30)}


def test_asof_plan(inputs):
    plan = asof_join(inputs.bars, inputs.index_bars)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("lineitem.parquet") <= 1
