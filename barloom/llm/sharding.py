"""Sharding by sampled splitters: shards are key ranges of near equal bytes.

1. A size-weighted sample of the keys is drawn: a row is taken with probability ``size * samples / total``, by a hash of
   its key, so a repeated task draws the same rows.
2. Quantiles of the sample are the boundaries of fine ranges. The number of ranges follows the number of rows, a range
   that holds more than ``overfull`` times its share is sampled and cut again, a heavy key inside by its row number.
3. One pass over each range gives every row its exact byte offset; offsets of ranges are sums of as many numbers as there
   are ranges. Offsets times the shard count, over the total, are the shards.

Defined results: a null text has 16 bytes. Null keys sort first. Repeated rows get a slot each, in any order among
themselves. An empty table gives no rows. Groups of one first key (copies of a text) of at most ``keep_together`` of a shard
stay in one shard; larger ones are cut, as one group may outgrow a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

SHARDS = 40
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 2_000_000
OVERSAMPLE = 8
OVERFULL = 4
KEEP_TOGETHER = 0.01
OVERHEAD = 16


def _draw(rows: DataFrame, total: int, samples: int, seed: int) -> list[tuple]:
    """About ``samples`` keys; rows of more than ``total / samples`` bytes are always drawn, and there are fewer of those than ``samples``."""
    unit = (F.xxhash64("k1", "k2", "k3", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    drawn = rows.where(unit * total < F.col("size") * samples).select("k1", "k2", "k3").collect()
    return sorted((r.k1, r.k2, r.k3) for r in drawn)


def _quantiles(keys: list[tuple], n: int) -> list[tuple]:
    """Boundaries. The first one with a key starts at the head of the key's rows, further ones (a heavy key) inside it."""
    picked = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    low = -(1 << 63)
    return [(k1, low, low) if not i or picked[i - 1][0] != k1 else (k1, k2, k3) for i, (k1, k2, k3) in enumerate(picked)]


def _range_of(bounds: list[tuple]) -> Column:
    """Binary search of a row's key in the sorted boundaries, as one fold over the powers of two."""
    if not bounds:
        return F.lit(0)
    literal = "array(" + ", ".join(f"named_struct('k1', {_long(a)}, 'k2', {_long(b)}, 'k3', {_long(c)})" for a, b, c in bounds) + ")"
    steps = "array(" + ", ".join(str(1 << i) for i in reversed(range(len(bounds).bit_length()))) + ")"
    n = len(bounds)
    return F.expr(f"aggregate({steps}, 0, (p, s) -> CASE WHEN p + s <= {n} AND element_at({literal}, p + s) <= named_struct('k1', k1, 'k2', k2, 'k3', k3) THEN p + s ELSE p END)")


def _long(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): ``docs`` in key ranges of equal bytes; the key is (text hash, doc_id, row)."""
    low = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), low).alias("k2"), F.monotonically_increasing_id().alias("k3")), "shard-rows")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(n_shards * RANGES_PER_SHARD, -(-n_rows // ROWS_PER_RANGE))
    share = max(total / ranges, 1)
    bounds = _quantiles(_draw(rows, total, ranges * OVERSAMPLE, seed), ranges) if total else []
    while True:
        placed = rows.withColumn("part", _range_of(bounds))
        stats = {r.part: r for r in placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()}
        over = [p for p, r in stats.items() if r.bytes > OVERFULL * share + r.largest and r.n > 1]
        new = set(bounds)
        for p in over:
            inside = placed.where(F.col("part") == p)
            pieces = int(-(-stats[p].bytes // share))
            new |= set(_quantiles(_draw(inside, stats[p].bytes, pieces * OVERSAMPLE, seed + len(bounds) + 1), pieces))
        if len(new) == len(bounds):
            break
        bounds = sorted(new)
    byte_off, row_off, at_byte, at_row = [], [], 0, 0
    for p in range(len(bounds) + 1):
        byte_off.append(at_byte)
        row_off.append(at_row)
        if p in stats:
            at_byte, at_row = at_byte + stats[p].bytes, at_row + stats[p].n
    offsets = lambda values: F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")
    ordered = Window.partitionBy("part").orderBy("k1", "k2", "k3")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("part", "k1")
    placed = (placed.withColumn("start", F.sum("size").over(so_far) - F.col("size") + F.element_at(offsets(byte_off), F.col("part") + 1))
              .withColumn("place", F.row_number().over(ordered) - 1 + F.element_at(offsets(row_off), F.col("part") + 1))
              .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group)))
    at = F.when(F.col("group_bytes") <= KEEP_TOGETHER * total / n_shards, F.col("group_start")).otherwise(F.col("start"))
    shard = F.least(F.floor(at.cast("decimal(38,0)") * n_shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int"), F.lit(n_shards - 1))
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "place"), "shard-places")
    heads = {r.shard: r.head for r in placed.groupBy("shard").agg(F.min("place").alias("head")).collect()}
    head = F.element_at(offsets([heads.get(s, 0) for s in range(n_shards)]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - head).cast("long").alias("slot"))
