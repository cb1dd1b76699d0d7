"""Walk-forward window tables and time-ordered splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import RESEARCH
from barloom.functions import rolling as R
from barloom.operators.moments import bucket_days


def windows_calendar(
    df: DataFrame, train_days: int = RESEARCH.train_days, test_days: int = RESEARCH.test_days,
    min_rows: int = RESEARCH.min_train_rows,
) -> DataFrame:
    """Fixed-length rolling windows in calendar days over trading rows.

    A window exists while its test span ends by the last date; windows with too few training rows or an
    empty test span are left out. Rows are counted once per bucket of days, and windows add up their buckets.
    """
    days = bucket_days(train_days, test_days)
    span, step = train_days // days, test_days // days
    dated = df.selectExpr("symbol", "date", "min(date) OVER (PARTITION BY symbol) AS first_date", "max(date) OVER (PARTITION BY symbol) AS last_date")
    buckets = dated.groupBy("symbol", "first_date", "last_date", F.expr(f"datediff(date, first_date) DIV {days} AS bucket")).agg(F.expr("count(*) AS _rows"))
    last = f"floor((datediff(last_date, first_date) - {train_days}) / {test_days})"
    # each window's empty row at its test start rides on the symbol's first bucket, so the rows are read once
    marks = f"IF(bucket = 0 AND {last} >= 1, transform(sequence(1, greatest(1, CAST({last} AS INT))), w -> struct(CAST((w - 1) * {step} + {span} AS BIGINT) AS bucket, 0L AS _rows, w AS window_id)), array())"
    rows = buckets.selectExpr("symbol", "first_date", f"inline(concat(array(struct(CAST(bucket AS BIGINT) AS bucket, _rows, CAST(NULL AS INT) AS window_id)), {marks}))")
    counted = rows.selectExpr(
        "symbol", "window_id", "first_date", f"date_add(first_date, (window_id - 1) * {test_days}) AS train_start",
        f"date_add(first_date, {train_days} + (window_id - 1) * {test_days}) AS test_start", f"date_add(first_date, {train_days} + window_id * {test_days}) AS test_end",
        f"coalesce(sum(_rows) OVER (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING), 0) AS train_rows",
        f"coalesce(sum(_rows) OVER (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN CURRENT ROW AND {step - 1} FOLLOWING), 0) AS test_rows",
    )
    return counted.where(f"window_id IS NOT NULL AND train_rows >= {min_rows} AND test_rows > 0")


def windows_rows(df: DataFrame, train: int = 500, step: int = 60, mode: str = "rolling") -> DataFrame:
    """Rows tagged with row-count windows: fit on ``train`` rows (all earlier rows when expanding), test on ``step``."""
    df = df.selectExpr("*", f"row_number() {R.over()} - 1 AS _rn", "count(*) OVER (PARTITION BY symbol) AS _n")
    last = f"floor((_n - 1 - {train}) / {step})"
    own = f"floor((_rn - {train}) / {step})"
    if mode == "rolling":
        lo, hi = f"greatest({own}, 0)", f"least(floor(_rn / {step}), {last})"
        train_from = f"window_id * {step}"
    else:
        lo, hi, train_from = f"greatest({own}, 0)", last, "0"
    out = df.where(f"_n > {train} AND {hi} >= {lo}").selectExpr(
        "*", f"explode(sequence(CAST({lo} AS INT), CAST({hi} AS INT))) AS window_id"
    )
    start = f"({train} + window_id * {step})"
    role = f"CASE WHEN _rn >= {start} AND _rn < {start} + {step} THEN 'test' WHEN _rn < {start} AND _rn >= {train_from} THEN 'train' END"
    return out.selectExpr("* EXCEPT (_rn, _n)", f"{role} AS role").where("role IS NOT NULL")


def time_series_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding cross-validation: fold k tests on the k-th of the last ``folds`` equal blocks."""
    df = df.selectExpr("*", f"row_number() {R.over()} - 1 AS _rn", "count(*) OVER (PARTITION BY symbol) AS _n")
    size = f"(_n DIV {folds + 1})"
    df = df.selectExpr("*", f"_n - {size} * {folds} AS _first", f"{size} AS _size").where("_size > 0")
    own = "IF(_rn < _first, -1, (_rn - _first) DIV _size)"
    out = df.selectExpr("*", f"explode(sequence(CAST(greatest({own}, 0) AS INT), {folds - 1})) AS fold")
    role = "IF(_rn >= _first + fold * _size, 'test', 'train')"
    return out.selectExpr("* EXCEPT (_rn, _n, _first, _size)", f"{role} AS role")


def time_split(df: DataFrame, frac: float = 0.8) -> DataFrame:
    """First ``floor(n * frac)`` rows of a symbol are 'train', the rest 'test'."""
    df = df.selectExpr("*", f"row_number() {R.over()} AS _rn", "count(*) OVER (PARTITION BY symbol) AS _n")
    return df.selectExpr("* EXCEPT (_rn, _n)", f"IF(_rn <= floor(_n * {frac}D), 'train', 'test') AS split")


def check_no_leakage(train: DataFrame, test: DataFrame, keys: list[str], raise_on_violation: bool = False) -> DataFrame:
    """Groups whose last training date is not before their first test date."""
    last = train.groupBy(*keys).agg(F.expr("max(date) AS max_train"))
    first = test.groupBy(*keys).agg(F.expr("min(date) AS min_test"))
    bad = last.join(first, keys).where("max_train >= min_test")
    if raise_on_violation and bad.head(1):
        raise ValueError("training rows are not strictly before the test rows")
    return bad
