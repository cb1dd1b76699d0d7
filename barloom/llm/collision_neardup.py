"""Embedding near-dedup by counting collisions of one-dimensional projections.

Every distinct vector, scaled to unit length, is projected on many random directions. Two vectors of cosine c differ on a
direction by a normal deviate of width sqrt(2 - 2 c), so they collide, that is lie in a window centred on either, on a known share of the directions.
A pair is a candidate if it collides on at least ``LEAST`` of ``COUNTED`` directions; that number follows from the recall wanted of
pairs at the limit. To count without looking at all pairs, some further directions deal the vectors into cells, wide against the
window; in a cell the vectors are sorted on one direction, and each counts the collisions with those in its window. As many tables of
cells are drawn as the recall at the limit needs, with more directions a cell the more vectors there are, so that cells keep their size
and the work grows a little faster than the vectors.

Candidates are not returned pair by pair: a cell yields a forest of them, the forests' components are found by joins, and
every pair of a component is verified by its cosine, in blocks of vectors. A component of more than ``BLOCK`` vectors is dealt into
blocks that meet pairwise in tasks of their own, so no group is gathered in one task; its links are counted in full, which is
the only work that grows with the square of a group of different vectors. Equal vectors are one vector.

A cell of more than ``CELL`` vectors is dealt into blocks, and all blocks whose windows reach each other meet in tasks of their own: the same
pairs are counted as in one task, none is left out.

Defined results: null, empty and zero vectors and those that hold null or non-finite components link with nothing. Vectors of different length don't link.
A null id is no component's id and never kept. Rows that repeat an id, or a vector, keep a row each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, release, stored
from barloom.llm.order_minhash import components

COSINE = 0.9
#: Share of the pairs at the limit that the tables find, and that the count lets pass; closer pairs are found more surely.
RECALL = 0.99
PASSED = 0.999
COUNTED = 64
#: Steps of the counted projections in half a window; values beyond 111 steps are held there, so differences fit a byte.
HALF, HELD = 16, 111
#: Vectors that share a cell on average, and at most in one task.
IN_CELL, CELL = 256, 4096
BLOCK = 4096
TABLES_A_ROUND = 4
SEED = 13


def same_cell(apart: float, width: float) -> float:
    """Chance that two values a normal deviate of ``apart`` from each other lie in one cell of a randomly shifted grid."""
    a = width / apart
    return math.erf(a / math.sqrt(2)) - 2 / (a * math.sqrt(2 * math.pi)) * (1 - math.exp(-a * a / 2))


def least_count(apart: float, half: float, directions: int = COUNTED, passed: float = PASSED) -> int:
    """The largest count that pairs so far ``apart`` reach with a chance of ``passed``."""
    p = math.erf(half / apart / math.sqrt(2))
    chance, count = 0.0, directions + 1
    while chance < passed:
        count -= 1
        chance += math.comb(directions, count) * p ** count * (1 - p) ** (directions - count)
    return count


class Plan:
    """Directions, cells and counts for ``n`` vectors of ``d`` dimensions."""

    def __init__(self, n: int, cosine: float = COSINE, recall: float = RECALL):
        self.apart = math.sqrt(2 - 2 * cosine)
        self.half = 2 * self.apart
        self.width = 2 * self.half
        self.least = least_count(self.apart, self.half)
        others = same_cell(math.sqrt(2), self.width)
        self.digits = max(1, round(math.log(max(n, 1) / IN_CELL) / -math.log(others))) if n > IN_CELL else 1
        meet = same_cell(self.apart, self.width) ** self.digits * math.erf(self.half / self.apart / math.sqrt(2))
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))

    def directions(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counted directions, cell directions and shifts, and multipliers that make one number of a cell's digits."""
        rng = np.random.default_rng((SEED, d))
        counted = rng.standard_normal((d, COUNTED))
        cells = rng.standard_normal((d, self.tables * self.digits))
        return counted, cells, rng.uniform(0, self.width, self.tables * self.digits), rng.integers(-2 ** 63, 2 ** 63, (self.tables, self.digits + 1)) | 1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) of each length in ``column``."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)] + 0.0


def _named(rows: DataFrame) -> DataFrame:
    """(vec_id, node, v) of usable rows: the node is a hash of the vector as doubles."""

    def run(batches):
        for batch in batches:
            nodes = [b""] * batch.num_rows
            for at, vectors in _by_length(batch.column(1)):
                for i, v in zip(at.tolist(), vectors):
                    nodes[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), batch.column(1)], names=["vec_id", "node", "v"])

    kind = rows.schema
    return rows.mapInArrow(run, f"vec_id {kind['vec_id'].dataType.simpleString()}, node binary, v {kind['v'].dataType.simpleString()}")


def _sketched(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(node, cells, sketch): the cell of each table, and the counted projections in steps, a byte each."""

    def run(batches):
        drawn = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                column = pa.concat_arrays([batch.column(1)])
                cells, sketches = np.zeros((batch.num_rows, plan.tables), np.int64), [b""] * batch.num_rows
                for at, vectors in _by_length(column):
                    d = vectors.shape[1]
                    if d not in drawn:
                        drawn[d] = plan.directions(d)
                    counted, ways, shifts, odd = drawn[d]
                    u = unit(vectors)
                    digits = np.floor((u @ ways + shifts) / plan.width).astype(np.int64).reshape(len(u), plan.tables, plan.digits)
                    cells[at] = mixed((digits * odd[:, :-1]).sum(axis=2) + odd[:, -1] * (d + 1))
                    steps = np.clip(np.rint(u @ counted * (HALF / plan.half)), -HELD, HELD).astype(np.int8)
                    for i, s in zip(at.tolist(), steps):
                        sketches[i] = s.tobytes()
                offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * plan.tables)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())), pa.array(sketches, pa.binary())], names=["node", "cells", "sketch"])

    return nodes.select("node", "v").mapInArrow(run, "node binary, cells array<long>, sketch binary")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits, so that near cells don't get near numbers."""
    x = x.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal first ``keys`` columns, which are sorted, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            column = batch.column(k)
            change |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)))
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


def joined(labels: np.ndarray, i: int, partners: np.ndarray) -> None:
    """Give ``i``, its ``partners`` and all that are joined to them the smallest of their labels."""
    met = labels[partners]
    low = min(int(met.min()), int(labels[i]))
    if labels[i] != low or (met != low).any():
        labels[np.isin(labels, np.append(met, labels[i]))] = low


def _forests(placed: DataFrame, least: int) -> DataFrame:
    """(a, b): in every cell a forest of the pairs whose windows collide at least ``least`` times. ``placed``: cell, at, node, sketch."""
    n = partitions(placed.sparkSession)
    window = np.uint8(2 * HALF)

    def run(batches):
        for rows in _runs(batches, 1):
            count = rows.num_rows
            if count < 2:
                continue
            steps = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.int8).reshape(count, COUNTED)
            order = np.argsort(steps[:, rows["at"][0].as_py()], kind="stable")
            steps = np.ascontiguousarray(steps[order].T)
            line = steps[rows["at"][0].as_py()].astype(int)
            ends = np.searchsorted(line, line + HALF, "right")
            centred, other = (steps.view(np.uint8) + np.uint8(HALF)), steps.view(np.uint8)
            labels = np.arange(count)
            for start in range(0, count, 256):
                stop = min(start + 256, count)
                last = ends[stop - 1]
                hits = np.zeros((stop - start, last - start), np.uint8)
                for m in range(COUNTED):
                    hits += (centred[m, start:stop, None] - other[m, None, start:last]) <= window
                passing = hits >= least
                for i in np.flatnonzero(passing.sum(axis=1) > 1).tolist():  # each collides with itself
                    partners = np.flatnonzero(passing[i, i + 1:ends[start + i] - start]) + start + i + 1
                    if len(partners):
                        joined(labels, start + i, partners)
            tied = np.flatnonzero(labels != np.arange(count))
            if len(tied):
                nodes = rows["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(order[tied])), nodes.take(pa.array(order[labels[tied]]))], names=["a", "b"])

    return placed.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a binary, b binary").distinct()


def _met_in_blocks(placed: DataFrame, most: int) -> DataFrame:
    """``placed`` with every cell of more than ``most`` vectors replaced by meetings of its blocks, so that no pair of a cell is lost.

    Slabs as wide as half a window, along the cell's sorted direction, hold a pair that can collide in one slab or in neighbours. A slab is dealt
    into blocks of about ``most`` vectors, and each block meets every other one of its slab and of both neighbours in a group of its own.
    """
    full = stored(placed.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most).select("cell"), "collide-full")
    if full.isEmpty():
        return placed
    slab = F.expr(f"int(((conv(hex(substring(sketch, at + 1, 1)), 16, 10) + 128) % 256) / {HALF})")
    hot = placed.join(full, "cell").withColumn("slab", slab)
    slabs = hot.groupBy("cell", "slab").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    slabs = slabs.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("slab", "blocks"))).alias("blocks"))
    number = "{} * 4294967296L + {}"  # of a block: its slab and its place there
    own = F.expr(number.format("slab", "pmod(xxhash64(node), blocks[slab])"))
    others = F.expr(f"""flatten(transform(filter(sequence(slab - 1, slab + 1), s -> map_contains_key(blocks, s)),
        s -> transform(sequence(0, blocks[s] - 1), b -> {number.format("s", "b")})))""")
    met = hot.join(slabs, "cell").select("cell", "at", "node", "sketch", own.alias("own"), F.explode(others).alias("other"))
    met = met.withColumn("cell", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).select(*placed.columns)
    return placed.join(full, "cell", "left_anti").unionByName(met)


def _links(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, others, label): links of each node and, in each task's part of a component, the first node joined to it.

    ``members``: component, node, copies, v.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = members.join(sizes, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies", "v")

    def run(batches):
        for rows in _runs(batches, 3):
            own = rows["own"].to_numpy()
            low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
            nodes, copies = rows["node"].combine_chunks(), rows["copies"].to_numpy()
            u = unit(next(_by_length(rows["v"].combine_chunks()))[1])
            first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
            labels, others = np.arange(len(u)), np.zeros(len(u), np.int64)
            for start in range(0, len(first), 512):
                part = first[start:start + 512]
                near = u[part] @ u[second].T >= cosine
                if low == high:
                    near[np.arange(len(part)), start + np.arange(len(part))] = False
                others[part] += near @ copies[second]
                if low != high:
                    others[second] += copies[part] @ near
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    joined(labels, int(part[i]), second[near[i]])
            linked = np.flatnonzero(others)
            if len(linked):
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(linked)), pa.array(others[linked]), nodes.take(pa.array(labels[linked]))], names=["node", "others", "label"])

    keys = ["component", "low", "high"]
    return met.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "node binary, others long, label binary")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    v = F.col("embedding")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    alone = embeddings.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = stored(_named(embeddings.where(usable).select("vec_id", v.alias("v"))), "collide-rows")
    nodes = stored(rows.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")), "collide-nodes")
    plan = Plan(nodes.count(), cosine, recall)
    sketches = stored(_sketched(nodes, plan), "collide-sketches")
    forests = None
    for start in range(0, plan.tables, TABLES_A_ROUND):
        here = range(start, min(start + TABLES_A_ROUND, plan.tables))
        cells = F.explode(F.array(*[F.struct(F.xxhash64(F.col("cells")[t], F.lit(t)).alias("cell"), F.lit(t % COUNTED).alias("at")) for t in here]))
        placed = sketches.select(cells.alias("c"), "node", "sketch").select("c.cell", "c.at", "node", "sketch")
        found = stored(_forests(_met_in_blocks(placed, cell), plan.least), "collide-forest")
        forests = found if forests is None else forests.union(found)
    candidates = components(forests).withColumnRenamed("label", "component")
    links = stored(_links(nodes.join(candidates, "node").select("component", "node", "copies", "v"), cosine, block), "collide-links")
    release(spark, sketches)
    tied = links.where(F.col("node") != F.col("label")).select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = components(tied)
    counted = nodes.select("node", "least", "copies").join(links.groupBy("node").agg(F.sum("others").alias("others")), "node", "left").join(labels, "node", "left")
    counted = stored(counted.select("node", "least", F.coalesce("label", "node").alias("label"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "collide-counted")
    least = counted.groupBy("label").agg(F.min("least").alias("component_id"))
    named = counted.join(least, "label").select("node", "n_links", "component_id")
    linked = rows.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
