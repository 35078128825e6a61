"""Corpus pipeline: documents in, packed token windows out.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns the pieces of the packed windows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge.llm.line_dedup import drop_boilerplate
from cdrforge.llm.near_dup import near_duplicates
from cdrforge.llm.packing import pack
from cdrforge.llm.quality_rules import quality_filter, train
from cdrforge.llm.substring_dedup import remove_repeats
from cdrforge.storage import Scratch

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose words stand in content lines."""
    return quality_filter(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; no document does. Copies come to the next stage whole: they count as one page."""
    return drop_boilerplate(docs, copies_once=True).select(docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Rows of one id with different texts stay or go each for itself; equal rows of
    one id are one document, and stay or go together. A row without an id is linked
    with nothing, so copies without ids all stay.
    """
    copies = near_duplicates(docs, digest=True).where("not kept").select(F.col("doc_id").alias("__copy_id"), F.col("text_hash").alias("__copy_hash"))
    return docs.join(copies, (F.col("doc_id") == F.col("__copy_id")) & (F.xxhash64("text") == F.col("__copy_hash")), "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a document with a smaller id holds go."""
    carried = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in carried.items()))
    out = remove_repeats(plain, carry=list(carried.values()), layout=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return out.select(*(new[c] if c in new else F.col(carried[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 1024."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
