"""Order statistics of moving frames: a sorted buffer per column, one insertion and one deletion per row.

The window form gathers and sorts a whole frame for every row. Here a series is read once in order; all columns and
quantiles of a symbol share the pass. A group is one symbol's series, bounded by the trading calendar.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


class SortedFrame:
    """The values of a frame in order; nulls are left out and only counted by their absence."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def add(self, x: float | None) -> None:
        if x is not None:
            insort(self.values, x)

    def remove(self, x: float | None) -> None:
        if x is not None:
            del self.values[bisect_left(self.values, x)]

    def quantile(self, q: float) -> float | None:
        """Linear interpolation between the two values around ``q * (n - 1)``."""
        if not self.values:
            return None
        at = q * (len(self.values) - 1)
        low = int(at)
        high = min(low + 1, len(self.values) - 1)
        return self.values[low] + (self.values[high] - self.values[low]) * (at - low)


def rolling_quantiles(
    df: DataFrame, specs: dict[str, tuple[str, float]], n: int, key: str = "symbol", order: str = "date", fill_back: bool = False,
) -> DataFrame:
    """``df`` with a quantile of the last ``n`` rows per spec ``{output: (column, quantile)}``, null unless all ``n`` are present.

    ``fill_back`` gives the rows before the first full frame, and any gap, the next value that follows.
    """
    columns = sorted({c for c, _ in specs.values()})

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        rows = table.num_rows
        series = {c: table[c].to_pylist() for c in columns}
        found: dict[str, list[float | None]] = {out: [None] * rows for out in specs}
        for c in columns:
            frame, values = SortedFrame(), series[c]
            wanted = [(found[out], q) for out, (column, q) in specs.items() if column == c]
            for i, x in enumerate(values):
                frame.add(x)
                if i >= n:
                    frame.remove(values[i - n])
                if len(frame.values) == n:
                    for out, q in wanted:
                        out[i] = frame.quantile(q)
        for out, values in found.items():
            if fill_back:
                following = None
                for i in range(rows - 1, -1, -1):
                    following = values[i] = following if values[i] is None else values[i]
            table = table.append_column(out, pa.array(values, pa.float64()))
        return table

    schema = StructType([*df.schema.fields, *(StructField(out, DoubleType()) for out in specs)])
    return df.groupBy(key).applyInArrow(run, schema)


def span_quantiles(
    df: DataFrame, cuts: dict[str, tuple[float, ...]], span: int, step: int, key: str = "symbol", order: str = "date", bucket: str = "bucket",
) -> DataFrame:
    """(key, window_id, ``_q{i}_{column}``): quantiles over the rows of ``span`` buckets, for windows that start ``step`` buckets apart.

    Window w holds buckets (w - 1) * step up to (w - 1) * step + span; each row enters and leaves the buffers once.
    """
    names = [f"_q{i}_{c}" for c, qs in cuts.items() for i in range(len(qs))]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        buckets = table[bucket].to_numpy()
        windows = np.arange(1, max(0, (int(buckets[-1]) - span) // step + 1) + 1) if table.num_rows else np.zeros(0, int)
        starts = np.searchsorted(buckets, (windows - 1) * step)
        ends = np.searchsorted(buckets, (windows - 1) * step + span)
        out: dict[str, list[float | None]] = {name: [] for name in names}
        for c, qs in cuts.items():
            values, frame, lo, hi = table[c].to_pylist(), SortedFrame(), 0, 0
            for start, end in zip(starts.tolist(), ends.tolist()):
                for x in values[hi:end]:
                    frame.add(x)
                for x in values[lo:start]:
                    frame.remove(x)
                lo, hi = start, max(hi, end)
                for i, q in enumerate(qs):
                    out[f"_q{i}_{c}"].append(frame.quantile(q))
        columns = [pa.array([table[key][0].as_py()] * len(windows), table.schema.field(key).type), pa.array(windows, pa.int64())]
        return pa.table([*columns, *(pa.array(out[name], pa.float64()) for name in names)], names=[key, "window_id", *names])

    schema = StructType([df.schema[key], StructField("window_id", LongType()), *(StructField(name, DoubleType()) for name in names)])
    return df.select(key, order, bucket, *cuts).groupBy(key).applyInArrow(run, schema)
