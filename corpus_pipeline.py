"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Quality classifier (rejected documents go), line dedup, near-dedup (the document of smallest id of each class stays),
benchmark decontamination, byte-level BPE (adds ``tokens`` and ``decoded_sha256``). All but the last return the columns of
``documents``. SQL cannot express the first, third and last stage, so there is no statement; tests hold the stages
against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontaminate, line_dedup, lsa_quality, order_minhash
from barloom.llm.common import free_name, stored, table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = lsa_quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return lsa_quality.scored(docs, model, score).where(F.col(score) >= lsa_quality.CUT).select(*docs.columns)


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``n_chars`` (if there is one) of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every line with text go."""
    total, dropped = free_name(docs, "line_total"), free_name(docs, "line_dropped")
    cut = line_dedup.dedup_lines(docs, total=total, dropped=dropped)
    return recounted(cut.where((F.col(dropped) == 0) | (F.btrim("text", F.lit(line_dedup.WHITE)) != "")), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays; of rows that repeat an id in a class, one."""
    return order_minhash.first_of_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids and a hash of what they decode to."""
    return bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, checked=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
