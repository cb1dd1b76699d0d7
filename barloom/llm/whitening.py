"""Embedding whitening: principal components by FEAST contour integration over an exact integer fit.

Vectors are put on a grid, x = floor(scale * c). Each distinct grid vector is fitted once: Spark sums the dimensions exactly, then
the products of the centred vectors, by blocks, so only sums of d and d * d numbers reach the driver. The components of the
covariance V come interval by interval. Inertia counts (signs of the pivots of V - s, by Sylvester's law) place the intervals and
say how many eigenvalues each holds. FEAST then filters a random subspace by quadrature along a circle around the interval:
sum of w_k (z_k - V)^-1 Y over complex shifts z_k, whose solves are independent Spark tasks; Rayleigh-Ritz in the
filtered subspace gives pairs, and the rounds go on until residuals are at rounding level and as many
pairs as the inertia count says lie inside.

Defined results: a vector that is null, empty, or holds null or non-finite entries is left out; of vectors of several lengths only those of
the most frequent length (the longest on a tie) take part. Entries beyond the range of a long are held at its ends.
Components whose eigenvalue is below rounding of the trace don't exist: fewer rows then, none for an empty table or a single grid vector.
Rows that repeat an id or a vector each get their rows. ``deviation`` is a decimal of 38 digits, null beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, stored

SCALE = 256
COMPONENTS = 4
#: Gauss-Legendre points on the upper half of the circle.
NODES = 8
#: Eigenvalues in one interval, at most (more if they are equal to rounding).
IN_INTERVAL = 8
ROUNDS = 40
SEED = 12
BLOCK_ROWS = 4096
#: Dimensions: V and its complex shifts are held whole, 16 * d * d bytes.
MAX_DIMENSIONS = 4096


def grid(vector: Column, scale: int = SCALE) -> Column:
    """x of every entry; null where the vector doesn't count."""
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension of ``fit`` (x), as whole numbers of any size."""

    def run(batches):
        for block in _blocks(batches):
            x = _matrix(block.column(0))
            high, low = x >> 32, x & 0xFFFFFFFF  # 4096 halves add up inside a long
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([high.sum(axis=0)], pa.list_(pa.int64())), pa.array([low.sum(axis=0)], pa.list_(pa.int64()))], names=["n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "n long, high array<long>, low array<long>")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = parts.select("n", F.posexplode(F.arrays_zip("high", "low"))).groupBy("pos").agg(total("n"), F.sum(F.col("col.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("col.low").cast("decimal(38,0)")).alias("low")).orderBy("pos").collect()
    return (int(sums[0].n) if sums else 0), [(int(r.high) << 32) + int(r.low) for r in sums]


def centre_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S / n as whole part and rest, each exact to a double, so that x - S / n loses nothing for large x."""
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def centred_products(rows: DataFrame, project) -> np.ndarray:
    """Sum over ``rows`` (x) of y y', y = ``project`` of a block; the upper triangle is summed by Spark."""

    def run(batches):
        total = None
        for block in _blocks(batches):
            y = project(_matrix(block.column(0)))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    size = int(cells.j.max()) + 1
    out = np.zeros((size, size))
    out[cells.i, cells.j] = cells.v
    return np.triu(out) + np.triu(out, 1).T


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` exceed ``shift``: positive pivots of v - shift, by elimination with 1 x 1 and 2 x 2 pivots."""
    a, count = v - shift * np.eye(len(v)), 0
    while len(a):
        sizes = np.abs(a)
        d = int(np.argmax(np.diagonal(sizes)))
        off = sizes - np.diag(np.diagonal(sizes))
        i, j = divmod(int(np.argmax(off)), len(a))
        if sizes[d, d] >= 0.6404 * off[i, j]:  # (1 + sqrt 17) / 8, which bounds the growth
            pivot = [d]
            count += a[d, d] > 0
            if not a[d, d]:
                break
        else:
            pivot = [i, j]
            count += 1  # such a block has one eigenvalue of each sign
        rest = np.delete(np.arange(len(a)), pivot)
        a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pivot)] @ np.linalg.solve(a[np.ix_(pivot, pivot)], a[np.ix_(pivot, rest)])
    return int(count)


def intervals(v: np.ndarray, wanted: int, most: int = IN_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, holding the ``wanted`` largest eigenvalues, by bisection on inertia counts."""
    top, under = float(np.abs(v).sum(axis=1).max()) * 1.001, 0.0
    out, high, done = [], top, 0
    for _ in range(8):  # a short interval makes a sharp filter
        middle = (under + high) / 2
        under, high = (middle, high) if above(v, middle) else (under, middle)
    while done < wanted:
        aim = min(most, wanted - done)
        low, up = -1e-3 * top, high
        for _ in range(60):
            middle = (low + up) / 2
            inside = above(v, middle) - done
            if inside == aim or up - low < 1e-9 * top:
                low = middle if inside >= aim else low
                break
            low, up = (middle, up) if inside > aim else (low, middle)
        if above(v, low) - done == aim:  # move the edge to about the middle of the gap, where the filter is sharpest
            bottom = -1e-3 * top
            for _ in range(12):
                middle = (bottom + low) / 2
                if above(v, middle) - done > aim:
                    bottom = middle
                else:
                    low = middle
            edge, lift = low, up
            for _ in range(12):
                middle = (edge + lift) / 2
                if above(v, middle) - done < aim:
                    lift = middle
                else:
                    edge = middle
            low = (bottom + edge) / 2
        count = above(v, low) - done
        out.append((low, high, count))
        high, done = low, done + count
    return out


def feast(spark, v: np.ndarray, spans: list[tuple[float, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) inside ``spans``."""
    d, size = len(v), float(np.abs(v).sum(axis=1).max())
    rng = np.random.default_rng(SEED)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    found, todo = {}, {k: rng.standard_normal((d, min(d, 2 * n + 4))) for k, (_, _, n) in enumerate(spans)}
    shared = spark.sparkContext.broadcast(v)
    for _ in range(ROUNDS):
        spaces = spark.sparkContext.broadcast(todo)

        def solve(batches, spaces=spaces):
            v = shared.value
            for batch in batches:
                for k, point, weight in zip(*(c.to_pylist() for c in batch.columns)):
                    low, high, _ = spans[k]
                    turn = np.exp(-0.5j * np.pi * (point - 1))
                    shift, radius = (low + high) / 2 + (high - low) / 2 * turn, (high - low) / 2
                    y = spaces.value[k]
                    part = weight * radius / 2 * (turn * np.linalg.solve(shift * np.eye(len(v)) - v, y.astype(complex))).real
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["k", "part"])

        tasks = [(k, float(p), float(w)) for k in todo for p, w in zip(points, weights)]
        solved = spark.createDataFrame(tasks, "k int, point double, weight double").repartition(min(len(tasks), partitions(spark)))
        filtered = {k: np.zeros_like(y) for k, y in todo.items()}
        for row in solved.mapInArrow(solve, "k int, part binary").collect():
            filtered[row.k] += np.frombuffer(row.part).reshape(filtered[row.k].shape)
        for k, y in filtered.items():
            low, high, n = spans[k]
            q = np.linalg.qr(y)[0]
            values, mixed = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ mixed
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == n and (rest <= 1e-13 * size * np.sqrt(d)).all():
                found[k] = values[inside], vectors[:, inside]
                del todo[k]
            else:  # the filtered space, with a direction of chance in case one was missing from the start
                todo[k] = np.column_stack((rng.standard_normal(d), vectors[:, 1:])) if vectors.shape[1] < d else vectors
        spaces.unpersist()
        if not todo:
            break
    shared.unpersist()
    if todo:
        raise ArithmeticError(f"no convergence within {ROUNDS} rounds in {[spans[k] for k in todo]}")
    values = np.concatenate([np.zeros(0), *(found[k][0] for k in found)])
    vectors = np.column_stack([np.zeros((d, 0)), *(found[k][1] for k in found)])
    order = np.argsort(-values, kind="stable")
    return values[order], np.linalg.qr(vectors[:, order])[0] if len(order) else vectors


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row of ``embeddings`` (key, embedding)."""
    spark = embeddings.sparkSession
    kind = embeddings.schema[key].dataType
    out_schema = f"{key} {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(key), grid(F.col("embedding"), scale).alias("x")).where("x IS NOT NULL")
    fit = stored(rows.groupBy("x").agg(F.count("*").alias("copies")), "white-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    d = lengths.d
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the covariance is built for {MAX_DIMENSIONS}")
    fit = fit.where(F.size("x") == d)
    n, sums = exact_sums(fit)
    whole, rest = centre_of(n, sums)
    centred = lambda x: (x - whole) - rest
    v = centred_products(fit, centred) / n
    trace = float(np.trace(v))
    least = 64 * d * np.finfo(float).eps * trace
    wanted = min(components, above(v, least)) if trace > 0 else 0
    if not wanted:
        return spark.createDataFrame([], out_schema)
    values, vectors = feast(spark, v, intervals(v, wanted))
    values, vectors = values[:wanted], vectors[:, :wanted]
    turn = vectors / np.sqrt(values)
    mean = centre_of_projection(fit, lambda x: centred(x) @ turn, n)
    covariance = centred_products(fit, lambda x: centred(x) @ turn - mean) / n
    error = float(np.abs(covariance - np.eye(wanted)).max())
    explained = values / trace
    small = float(2 ** 62) / d

    def run(batches):
        for block in _blocks(batches):
            x = _matrix(block.column(1))
            if max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) < min(small ** 0.5, 2 ** 62):
                off = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                off = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
            off = [Decimal(o) if o < 10 ** 38 else None for o in off]
            y = centred(x) @ turn
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                block.column(0).take(pa.array(np.repeat(np.arange(m), wanted))), pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), m)), pa.array(np.full(m * wanted, n)),
                pa.array([o for o in off for _ in range(wanted)], pa.decimal128(38, 0)), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * wanted, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(run, out_schema)


def centre_of_projection(fit: DataFrame, project, n: int) -> np.ndarray:
    """The mean over ``fit`` of the projected rows."""

    def run(batches):
        for block in _blocks(batches):
            y = project(_matrix(block.column(0))).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y), dtype=np.int32)), pa.array(y)], names=["i", "v"])

    return np.array([r.v for r in fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]) / n
