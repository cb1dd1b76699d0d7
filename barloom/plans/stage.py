"""Shared stages: a frame that several branches of a job read is computed once and kept as Parquet.

Branches that start from the same lazy frame each plan and run it again. A stage writes it to the folder of
``spark.checkpoint.dir``, which driver and executors share, so later branches scan a few columns of a small file, lost executors lose
nothing, and the lineage ends there. The files go when the application ends, or earlier by :func:`drop_stages`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGES: list[str] = []


def stage_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-stage-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed now and read back from its stage."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    df.write.parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the stages written so far, once no frame that reads them will be run again; returns how many."""
    count = len(_STAGES)
    while _STAGES:
        where, files = _hadoop(spark, _STAGES.pop())
        files.delete(where, True)
    return count
