"""Reads to unique CDR3 nodes, and counts over reads; ``by`` names columns, such as a donor, whose values are kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def collapse(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes: cdr3, cdr_length (of the first read in input order), v_call and j_call (unions), n_reads.

    What is shuffled for a node is its distinct calls, each a short list of names.
    """
    base = reads.groupBy(*by, "cdr3").agg(F.min_by("cdr_length", "ord").alias("cdr_length"), F.count("*").alias("n_reads"), *(F.collect_set(c).alias(c) for c in ("v_call", "j_call")))
    return base.select(*by, "cdr3", "cdr_length", *map(_union, ("v_call", "j_call")), "n_reads")


def _union(c: str):
    return F.array_sort(F.array_distinct(F.flatten(c))).alias(c)


def merge_nodes(nodes: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Nodes of several loads into one each: genes united, reads added up, the length of the load that comes first by ``order``."""
    base = nodes.groupBy(*by, "cdr3").agg(F.min_by("cdr_length", order).alias("cdr_length"), F.sum("n_reads").alias("n_reads"), *(F.collect_set(c).alias(c) for c in ("v_call", "j_call")))
    return base.select(*by, "cdr3", "cdr_length", *map(_union, ("v_call", "j_call")), "n_reads")


def load_summary(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_reads, n_unique_cdr3, and n_length_differs: reads whose reported length is not their string's."""
    return reads.groupBy(*by).agg(F.count("*").alias("n_reads"), F.count_distinct("cdr3").alias("n_unique_cdr3"), F.count_if(F.length("cdr3") != F.col("cdr_length")).alias("n_length_differs"))


def reads_per_cdr3(reads: DataFrame) -> DataFrame:
    return reads.groupBy("cdr3").agg(F.count("*").alias("n_reads"))


def v_gene_usage(reads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads per V gene; a read with several calls counts once for each. Genes without a read have no row."""
    return reads.select(*by, F.explode("v_call").alias("v_gene")).groupBy(*by, "v_gene").agg(F.count("*").alias("reads"))
