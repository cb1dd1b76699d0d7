"""Line dedup over levelled sorted runs of line hashes (a log-structured merge of the corpus' lines).

A run is a table of line keys, bucketed and sorted by their 128-bit hash, and no key stands in two runs. A new batch of
documents is reduced to one row per key and merge-anti-joined with each run. Keys that no run holds become a run of level 0;
the others only raise counts and largest ids, as a run of updates. When a level holds ``fan_in`` runs they are merged into one
of the next level: runs of keys are put together as they are, runs of updates are summed. Runs are never shuffled by a
later batch: both sides of the merge joins have the buckets' partitioning. The number of batches follows the rows.

Defined results: a null or empty text is one empty line. Rows that share a ``doc_id`` are one document for the counts;
rows with a null ``doc_id`` are one document that comes before all others. An empty table gives no rows. Of the other columns of
the input only those with the names of the added ones are touched: they are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import WHITE, ascii_lower, delete_path, partitions, scratch_path, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: At least so many batches, and more once a batch would put more rows than this in a bucket.
BATCHES = 4
BATCH_ROWS = 1 << 20
FAN_IN = 4


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def key_hash(key: Column) -> Column:
    """128 bits as two longs: two seeds of xxhash64."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs. ``add`` takes batches of (doc_id, h1, h2); no document may lie in two of them."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.buckets = spark, fan_in, partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.updates: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        """``rows`` must be dealt by (h1, h2) to the buckets, so that each gives one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        (rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", self.paths[name]).format("parquet").saveAsTable(name))
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop the tables and their files; frames that read them must have been stored."""
        self._drop(*list(self.paths))
        self.levels, self.updates = [[]], [[]]

    def add(self, pairs: DataFrame) -> DataFrame:
        """Add a batch; returns the run of its new keys, to be read before the next batch."""
        keys = pairs.groupBy("h1", "h2").agg(
            (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        batch = fresh = self._write(keys.repartition(self.buckets, "h1", "h2"))
        earlier = [name for level in self.levels for name in level]
        if earlier:
            new = self.spark.table(batch)
            for name in earlier:
                new = new.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
            fresh = self._write(new)
            known = self.spark.table(batch).join(self.spark.table(fresh).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self._put(self.updates, self._write(known), self._summed)
            self._drop(batch)
        self._put(self.levels, fresh, self._files)
        return self.spark.table(fresh if fresh in self.paths else self.levels[-1][-1])

    def _put(self, levels: list[list[str]], name: str, merge) -> None:
        """Add a run at level 0 and compact full levels."""
        levels[0].append(name)
        level = 0
        while len(levels[level]) >= self.fan_in:
            merged = self._write(merge(levels[level]).repartition(self.buckets, "h1", "h2"))
            self._drop(*levels[level])
            if len(levels) == level + 1:
                levels.append([])
            levels[level + 1].append(merged)
            levels[level] = []
            level += 1

    def _files(self, names: list[str]) -> DataFrame:
        # read as files: Spark 4.1 takes a union of bucketed tables for dealt by key even where it then reads them unbucketed
        return self.spark.read.parquet(*[self.paths[name] for name in names])

    def _summed(self, names: list[str]) -> DataFrame:
        return self._files(names).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def totals(self) -> DataFrame:
        """One row per key: each run's keys merge-joined with their updates."""
        changes = [name for level in self.updates for name in level]
        names = [name for level in self.levels for name in level]
        rows = self.spark.table(names[0]) if len(names) == 1 else self._files(names)
        if not changes:
            return rows
        more = (self.spark.table(changes[0]) if len(changes) == 1 else self._summed(changes)).select("h1", "h2", F.col("n_docs").alias("more"), F.col("max_doc").alias("later"))
        return rows.join(more, ["h1", "h2"], "left").select(
            "h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "later").alias("max_doc"))


def line_pairs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (doc_id, h1, h2) of each text's lines whose key has at least ``min_chars`` code points."""
    keys = F.transform(text_lines(F.col("text")), line_key)
    long_keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    hashes = F.array_distinct(F.transform(long_keys, key_hash))
    return docs.select("doc_id", F.explode(hashes).alias("h")).select("doc_id", "h.h1", "h.h2")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(doc_id, h1, h2) of the lines each document loses: keys of ``min_docs`` documents, except in the largest id.

    Batches are ranges of ``doc_id``; a document never lies in two, so counts of batches add up. Keys with more than an even
    share of the rows, fewer than there are partitions, are looked up where the rows lie; only the rest is dealt by key.
    """
    spark = docs.sparkSession
    pairs = stored(line_pairs(docs.select("doc_id", "text"), min_chars), "line-pairs")
    rows, runs = pairs.count(), LineRuns(spark)
    batches = max(batches, -(-rows // (batch_rows * runs.buckets)))
    cuts = sorted(set(pairs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], min(0.02, 0.1 / batches))))
    edges = [None, *map(int, cuts), None]
    for low, high in zip(edges[:-1], edges[1:]):
        part = pairs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) if low is not None else (F.col("doc_id").isNull() | (F.col("doc_id") <= high)))
        runs.add(part)
    hot = stored(runs.totals().where(F.col("n_docs") >= min_docs), "line-hot")
    runs.close()
    share = rows // runs.buckets
    heavy = F.broadcast(hot.where(F.col("n_docs") > share).select("h1", "h2", "max_doc"))  # fewer keys than buckets
    light = pairs.join(heavy.drop("max_doc"), ["h1", "h2"], "left_anti").join(hot.where(F.col("n_docs") <= share).select("h1", "h2", "max_doc"), ["h1", "h2"])
    both = pairs.join(heavy, ["h1", "h2"]).unionByName(light)
    return both.where(~F.col("doc_id").eqNullSafe(F.col("max_doc"))).select("doc_id", "h1", "h2")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, total: str = "line_total", dropped: str = "line_dropped") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``total`` and ``dropped`` (names of long columns). Texts without a lost line stay as they are."""
    lost = repeated_lines(docs, min_chars, min_docs, batches)
    lost = lost.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("h1", "h2")).alias("__lost"))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["__doc"]), "left").drop("__doc")
    lines = text_lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~bool_in(F.col("__lost"), x, min_chars))
    cut = joined.withColumn(total, F.size(lines).cast("long")).withColumn("__kept", F.when(F.col("__lost").isNotNull(), kept))
    return (cut.withColumn(dropped, F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(F.col(total) - F.size("__kept")).cast("long"))
            .withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")))
            .drop("__lost", "__kept"))


def bool_in(lost: Column, line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return (F.char_length(key) >= min_chars) & F.array_contains(lost, key_hash(key))
