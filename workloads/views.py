"""Input views over the given tables, written in SQL that Spark and DuckDB both run.

They give every operator an input of the right shape: daily bars per brand from ``lineitem`` and ``part``,
news from ``documents``, fills and order ledgers from ``lineitem`` and ``orders``, account telemetry from
``events``. Sums are kept in integers and rounding uses ``floor``, so both engines agree on every row.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.stage import staged

TABLES = ("lineitem", "part", "orders", "documents", "events")


def _epoch_us(d: str, ts: str) -> str:
    return f"unix_micros(CAST({ts} AS TIMESTAMP))" if d == "spark" else f"epoch_us({ts})"


def _from_us(d: str, us: str) -> str:
    return f"timestamp_micros({us})" if d == "spark" else f"make_timestamp({us})"


def _daily(d):
    return """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS sd,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS st, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


def _micro(d):
    # A comment for DuckDB, a hint for Spark: bars are few bytes but feed many window frames, and adaptive
    # coalescing sizes tasks by bytes, so the one exchange on the symbol is pinned to a task per core.
    return """
SELECT /*+ REPARTITION({cores}, symbol) */ symbol, date, volume, CAST(floor((sd - 5 * n) * 4500e0 / n) AS BIGINT) AS lr,
       CAST(floor((st - 4 * n) * 2000e0 / n) AS BIGINT) AS g FROM daily"""


def _walk(d):
    return """
SELECT symbol, date, volume, g, floor(1e8 * exp(sum(lr) OVER (PARTITION BY symbol ORDER BY date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e6)) / 1e6 AS close FROM micro"""


def _oc(d):
    return """
SELECT *, floor(coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 1e2) * (1e6 + g)) / 1e6 AS open FROM walk"""


def _bars(d):
    return """
SELECT symbol, date, open, floor(greatest(open, close) * 1004e3) / 1e6 AS high,
       floor(least(open, close) * 996e3) / 1e6 AS low, close, volume FROM oc"""


def _index_day(d):
    return """
SELECT date, count(*) AS n, CAST(sum(CAST(round(close * 1e6) AS BIGINT)) AS BIGINT) AS total FROM bars GROUP BY date"""


def _index_bars(d):
    # The benchmark prints on days when at least the average number of members traded: natural gaps.
    return """
SELECT date, floor(total / (n * 1e0)) / 1e6 AS close FROM index_day WHERE n >= (SELECT avg(n) FROM index_day)"""


def _news(d):
    ts = _from_us(d, "(9131 * 24 + (doc_id * 37 % 2490) * 24 + doc_id % 24) * 3600000000")
    return f"""
SELECT concat('Brand#', CAST(1 + doc_id % 25 AS VARCHAR(2))) AS symbol, {ts} AS ts, doc_id, text AS headline, source, lang
FROM documents"""


def _fills(d):
    submit = _epoch_us(d, "l_shipdate")
    fill = _from_us(d, f"{submit} + CAST(round(l_tax * 100) AS BIGINT) * 1250000 + CAST(l_linenumber AS BIGINT) * 90000")
    return f"""
SELECT md5(concat(CAST(l_orderkey AS VARCHAR(20)), '|', CAST(l_partkey AS VARCHAR(20)), '|',
           CAST(l_suppkey AS VARCHAR(20)), '|', CAST(l_linenumber AS VARCHAR(20)))) AS order_id,
       p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
       p_retailprice AS expected_price, p_retailprice * (1e0 + (l_discount - 5e-2) / 50e0) AS actual_fill_price,
       l_quantity AS qty, {_from_us(d, submit)} AS submit_ts, {fill} AS fill_ts,
       l_linestatus = 'F' AS partial_fill
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _order_ledger(d):
    # The desk's own book: lines that were not returned, for orders that are not pending.
    return """
SELECT concat('O', CAST(l_orderkey AS VARCHAR(20))) AS client_order_id, sum(l_quantity) AS filled_qty,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e2 / sum(l_quantity) AS avg_price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R' GROUP BY 1"""


def _broker_fills(d):
    return """
SELECT concat('O', CAST(l_orderkey AS VARCHAR(20))) AS client_order_id, sum(l_quantity) AS filled_qty,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e2 / sum(l_quantity) AS avg_price
FROM lineitem GROUP BY 1"""


def _account_events(d):
    return f"""
SELECT event_id, user_id AS account_id, {_from_us(d, _epoch_us(d, 'ts'))} AS ts,
       1e5 + value * (CASE WHEN event_type IN ('error', 'signup') THEN -10e0 ELSE 10e0 END) AS equity,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 1e2 AS confidence, value / 25e0 AS slippage_bps,
       floor(value) AS position, floor(value) + (CASE WHEN event_type = 'signup' THEN 2e0 ELSE 0e0 END) AS expected_position,
       event_type <> 'error' AS api_success
FROM events"""


def _signals(d):
    return f"""
SELECT event_id, {_from_us(d, _epoch_us(d, 'ts'))} AS ts, CAST(ts AS DATE) AS day,
       concat('Brand#', CAST(1 + user_id % 25 AS VARCHAR(2))) AS symbol, CAST(user_id AS VARCHAR(20)) AS signal_id,
       CASE event_type WHEN 'purchase' THEN 'ENTER_LONG' WHEN 'signup' THEN 'EXIT_TO_CASH' ELSE 'HOLD' END AS signal,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 1e2 AS confidence
FROM events"""


def _preds(d):
    # A closed-form momentum forecaster: enough to drive every back-test query with real abstentions.
    return """
SELECT symbol, date, 'momentum' AS model, prob_up, abs(2e0 * prob_up - 1e0) AS confidence,
       CASE WHEN abs(2e0 * prob_up - 1e0) < 3e-1 THEN 0 WHEN prob_up > 5e-1 THEN 1 WHEN prob_up < 5e-1 THEN -1 ELSE 0 END AS signal,
       actual_return, CASE WHEN actual_return > 0 THEN 1 WHEN actual_return < 0 THEN -1 ELSE 0 END AS actual_direction
FROM (SELECT symbol, date, 1e0 / (1e0 + exp(-40e0 * (close / lag(close, 5) OVER w - 1e0))) AS prob_up,
             (lead(open, 2) OVER w - lead(open, 1) OVER w) / lead(open, 1) OVER w AS actual_return
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)) f
WHERE prob_up IS NOT NULL AND actual_return IS NOT NULL"""


def _last_bars(d):
    return """
SELECT symbol, max(date) AS as_of, max_by(close, date) AS underlying_price FROM bars GROUP BY symbol"""


def _option_quotes(d):
    # Six expiries and 21 strikes around the last close of every symbol, both option types.
    if d == "spark":
        source = """last_bars LATERAL VIEW explode(sequence(1, 6)) x AS n LATERAL VIEW explode(sequence(-10, 10)) y AS k"""
        exp, types = "date_add(as_of, n * 15 + 5)", "explode(array('call', 'put'))"
    else:
        source = """(SELECT *, unnest(range(-10, 11)) AS k FROM (SELECT *, unnest(range(1, 7)) AS n FROM last_bars) a) b"""
        exp, types = "CAST(as_of + CAST(n * 15 + 5 AS INTEGER) AS DATE)", "unnest(['call', 'put'])"
    return f"""
SELECT underlying, as_of, expiration, dte, strike, option_type, price * 95e-2 AS bid, price * 105e-2 AS ask, price AS last,
       CASE WHEN volume_raw > 9000 THEN NULL ELSE volume_raw END AS volume, open_interest, iv, underlying_price
FROM (
  SELECT *, CASE WHEN (option_type = 'call') = (strike < underlying_price) THEN abs(underlying_price - strike) + time_value
              ELSE time_value * 8e-1 END AS price,
         CAST(floor(strike * 37 + dte * 11) AS BIGINT) % 10000 AS volume_raw,
         CAST(floor(strike * 53 + dte * 29) AS BIGINT) % 50000 AS open_interest
  FROM (
    SELECT underlying, as_of, expiration, dte, strike, underlying_price, {types} AS option_type,
           2e-1 + abs((strike - underlying_price) / underlying_price) * 5e-1 AS iv,
           sqrt(dte / 365e0) * (2e-1 + abs((strike - underlying_price) / underlying_price) * 5e-1) * underlying_price * 4e-1 AS time_value
    FROM (
      SELECT symbol AS underlying, as_of, {exp} AS expiration, CAST(n * 15 + 5 AS INT) AS dte,
             floor(underlying_price * (1e0 + k / 1e2) + 5e-1) AS strike, underlying_price
      FROM {source}) s) q) p"""


def _option_positions(d):
    return """
SELECT l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS opened, l_orderkey, l_partkey, l_linenumber, l_quantity,
       CASE l_linenumber WHEN 1 THEN 'long_call' WHEN 2 THEN 'covered_call' WHEN 3 THEN 'protective_put' WHEN 4 THEN 'short_call'
            WHEN 5 THEN 'short_put' WHEN 6 THEN 'iron_condor' ELSE 'stock' END AS position_type,
       CASE WHEN l_linenumber IN (1, 2, 4) THEN 'call' ELSE 'put' END AS option_type, l_linenumber > 3 AS is_short,
       p_retailprice / 10e0 AS underlying_price, p_retailprice / 10e0 * (1e0 + (l_discount - 5e-2) * 4e0) AS strike,
       l_tax * 50e0 AS premium, CAST(1 AS INT) AS contracts, CAST(NULL AS DOUBLE) AS spread_width, CAST(l_quantity AS INT) AS dte
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _trades(d):
    return f"""
SELECT md5(CAST(o_orderkey AS VARCHAR(20))) AS order_id, {_from_us(d, _epoch_us(d, 'o_orderdate'))} AS timestamp,
       concat('Brand#', CAST(1 + o_custkey % 25 AS VARCHAR(2))) AS symbol,
       CASE o_orderstatus WHEN 'F' THEN 'ENTER_LONG' WHEN 'O' THEN 'EXIT_TO_CASH' ELSE 'HOLD' END AS action,
       CASE WHEN o_orderstatus = 'P' THEN 'NO_ACTION' ELSE 'filled' END AS order_status, o_totalprice AS notional,
       o_orderpriority AS signal_source
FROM orders"""


VIEWS = {
    "daily": (_daily, ()), "micro": (_micro, ("daily",)), "walk": (_walk, ("micro",)), "oc": (_oc, ("walk",)),
    "bars": (_bars, ("oc",)), "index_day": (_index_day, ("bars",)), "index_bars": (_index_bars, ("index_day",)),
    "news": (_news, ()), "fills": (_fills, ()), "order_ledger": (_order_ledger, ()), "broker_fills": (_broker_fills, ()),
    "account_events": (_account_events, ()), "signals": (_signals, ()), "preds": (_preds, ("bars",)),
    "last_bars": (_last_bars, ("bars",)), "option_quotes": (_option_quotes, ("last_bars",)), "trades": (_trades, ()),
    "option_positions": (_option_positions, ()),
}


def _closure(names, seen: dict[str, str], texts) -> None:
    for name in names:
        if name in seen:
            continue
        body, deps = texts(name)
        _closure(deps, seen, texts)
        seen[name] = body


def _spark_views(name: str, stored: tuple[str, ...]) -> dict[str, str]:
    seen: dict[str, str] = {}
    _closure([name], seen, lambda n: (VIEWS[n][0]("spark"), [d for d in VIEWS[n][1] if d not in stored]))
    return seen


def spark_text(name: str, stored: tuple[str, ...] = ()) -> str:
    """The view as a statement over the given tables and the views already ``stored``."""
    seen = _spark_views(name, stored)
    ctes = ",\n".join(f"{n} AS ({b})" for n, b in seen.items())
    return f"WITH {ctes}\nSELECT * FROM {name}"


def tables_of(name: str, stored: tuple[str, ...] = ()) -> list[str]:
    words = set(re.findall(r"[a-z_]+", " ".join(_spark_views(name, stored).values())))
    return [t for t in TABLES if t in words]


class Inputs:
    """Lazily built input frames for one data directory; ``t.bars`` is the ``bars`` view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def stage(self, *names: str) -> "Inputs":
        """Inputs whose views ``names`` are computed once, now; views on top of them read what was stored."""
        out = Inputs(self.spark, self.sf_dir)
        out._stored = {name: staged(getattr(self, name), name) for name in names}
        out._frames = dict(out._stored)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._frames:
            for table in tables_of(name, tuple(self._stored)):
                self.table(table).createOrReplaceTempView(table)
            for stored_name, frame in self._stored.items():
                frame.createOrReplaceTempView(stored_name)
            text = spark_text(name, tuple(self._stored)).replace("{cores}", str(self.spark.sparkContext.defaultParallelism))
            self._frames[name] = self.spark.sql(text)
        return self._frames[name]


def duck_with(body: str, extra: dict[str, str]) -> str:
    """``body`` preceded by every view it names, directly or through another view."""

    def texts(name: str):
        text = extra[name] if name in extra else VIEWS[name][0]("duck")
        words = set(re.findall(r"[a-z_0-9]+", text))
        return text, [n for n in list(VIEWS) + list(extra) if n in words and n != name]

    words = set(re.findall(r"[a-z_0-9]+", body))
    seen: dict[str, str] = {}
    _closure([n for n in list(VIEWS) + list(extra) if n in words], seen, texts)
    if not seen:
        return body
    ctes = ",\n".join(f"{n} AS ({b.strip()})" for n, b in seen.items())
    return f"WITH {ctes}\n{body}"
