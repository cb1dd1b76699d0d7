"""Kill-switch monitor as a stateful stream in event time: one small state and a reorder buffer per account.

Events wait in slots of a few seconds of event time. When the watermark passes a slot's end, its timer fires and the slot's
events run through the monitor in order of time and id, so files that come late or out of order, within the watermark's
delay, give the same rows as the batch form. Slots hold Arrow bytes and are read one at a time; an input batch is taken
chunk by chunk. An account without a halt or a run of errors is forgotten after some idle days, since a new day starts it
afresh anyway; a halt is never forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.config import KILL_SWITCH, KillSwitchLimits

OUTPUT = (
    "account_id bigint, event_id bigint, ts timestamp, daily_pnl_pct double, switch_type string, action string, "
    "triggered boolean, halted boolean"
)
STATE = "halted boolean, errors bigint, day bigint, start_equity double, last_ms bigint"
START = (False, 0, None, 0.0, 0)
COLUMNS = ["event_id", "ts", "equity", "confidence", "slippage_bps", "position", "expected_position", "api_success"]
DAY_MS = 86_400_000


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def advance(state: tuple, rows: pd.DataFrame, limits: KillSwitchLimits = KILL_SWITCH) -> tuple[tuple, pd.DataFrame]:
    """The monitor over ``rows`` in event order, from ``state`` to the state after them; all checks are array operations.

    Checks in order: daily loss, confidence, API errors, slippage, position. The first two keep a row from the API
    counter. The counter is the number of failures since the last success among the rows that reach it.
    """
    halted, errors, day, start, _ = state
    n = len(rows)
    ms = rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
    days, equity = ms // DAY_MS, rows["equity"].to_numpy(float)
    opens = np.flatnonzero(np.concatenate(([day is None or days[0] != day], days[1:] != days[:-1])))
    firsts = np.full(n, start)
    if len(opens):
        firsts[opens[0]:] = np.repeat(equity[opens], np.diff([*opens, n]))
    pnl = np.where(firsts != 0, (equity - firsts) / np.where(firsts != 0, firsts, 1) * 100, 0.0)
    kind = np.full(n, None, object)
    early = (pnl < -limits.max_daily_loss_pct) | (rows["confidence"].to_numpy(float) < limits.min_confidence)
    kind[early] = "confidence_collapse"
    kind[pnl < -limits.max_daily_loss_pct] = "daily_loss"
    late = np.flatnonzero(~early)
    failed = ~rows["api_success"].to_numpy(bool)[late]
    place = np.arange(1, len(late) + 1)
    since = place - np.maximum.accumulate(np.where(failed, 0, place)) if len(late) else place
    unbroken = np.cumsum(~failed) == 0
    run = since + np.where(unbroken, errors, 0)
    expected = rows["expected_position"].to_numpy(float)[late]
    off = np.abs(rows["position"].to_numpy(float)[late] - expected) > np.maximum(1.0, np.abs(expected) * 0.05)
    slip = np.abs(rows["slippage_bps"].to_numpy(float)[late]) > limits.max_slippage_bps
    found = np.where(run >= limits.max_api_errors, "api_error", np.where(slip, "slippage_breach", np.where(off, "unexpected_position", "")))
    kind[late] = np.where(found == "", None, found.astype(object))
    stop = np.isin(kind.astype(str), ["api_error", "slippage_breach"])
    before = np.concatenate(([halted], np.logical_or.accumulate(stop)[:-1] | halted)) if n else np.zeros(0, bool)
    kind[before] = None
    action = np.where(before | stop, "halt", np.where(kind.astype(str) == "None", "none", "flatten"))
    out = pd.DataFrame({
        "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(), "daily_pnl_pct": pnl, "switch_type": kind, "action": action,
        "triggered": before | (kind.astype(str) != "None"), "halted": before,
    })
    return (bool(halted or stop.any()), int(run[-1]) if len(late) else errors, int(days[-1]), float(firsts[-1]), int(ms[-1])), out


class KillSwitchProcessor(StatefulProcessor):
    def __init__(self, limits: KillSwitchLimits, slot_ms: int, idle_ms: int):
        self.limits, self.slot_ms, self.idle_ms = limits, slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("monitor", STATE)
        self.slots = handle.getMapState("slots", "slot bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            slots = chunk["ts"].astype("datetime64[ms]").astype("int64") // self.slot_ms
            for slot, part in chunk[COLUMNS].groupby(slots.to_numpy()):
                at = (int(slot),)
                if self.slots.containsKey(at):
                    part = pd.concat([_unpack(self.slots.getValue(at)[0]), part])
                else:
                    self.handle.registerTimer((int(slot) + 1) * self.slot_ms)
                self.slots.updateValue(at, (_pack(part),))
        yield pd.DataFrame(columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = self.state.get() if self.state.exists() else START
        due = sorted(k[0] for k in self.slots.keys() if (k[0] + 1) * self.slot_ms <= now)
        for slot in due:
            rows = _unpack(self.slots.getValue((slot,))[0]).sort_values(["ts", "event_id"], kind="stable")
            self.slots.removeKey((slot,))
            state, out = advance(state, rows, self.limits)
            out.insert(0, "account_id", key[0])
            yield out
        if due:
            self.state.update(state)
            self.handle.registerTimer(state[4] + self.idle_ms)
        elif self.state.exists() and not state[0] and not state[1] and state[4] + self.idle_ms <= now:
            self.state.clear()

    def close(self) -> None:
        pass


def kill_switch_stream(
    events: DataFrame, limits: KillSwitchLimits = KILL_SWITCH, delay: str = "10 minutes", slot_seconds: int = 10, idle_days: int = 7,
) -> DataFrame:
    """Streaming twin of :func:`barloom.operators.killswitch.kill_switch`; needs the RocksDB state store.

    Rows come out once the watermark, ``delay`` behind the latest event, has passed their slot. Rows later than that are dropped.
    """
    if idle_days < 2:
        raise ValueError("an account may only be forgotten after its last day has ended")
    processor = KillSwitchProcessor(limits, slot_seconds * 1000, idle_days * DAY_MS)
    return events.withWatermark("ts", delay).groupBy("account_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
