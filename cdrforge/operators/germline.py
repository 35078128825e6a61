"""Germline preparation: header rewriting, FASTA per segment, V annotation rows, database titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cdrforge.functions.sequences import dot_count, imgt_gene, without_gaps


def rewrite_imgt(lines: DataFrame, column: str = "value") -> DataFrame:
    """Header lines become ``>gene``; all other lines lose their dots."""
    gene = imgt_gene(F.col(column))
    return lines.withColumn(column, F.when(gene.isNotNull(), F.concat(F.lit(">"), gene)).otherwise(without_gaps(F.col(column))))


def alleles(sets: DataFrame) -> DataFrame:
    """One row per allele of each set: file, title, pos and the allele's fields."""
    title = F.concat_ws(" ", "set.germline_set_name", "set.germline_set_ref").alias("title")
    return sets.select("file", title, F.posexplode("set.allele_descriptions").alias("pos", "allele")).select("file", "title", "pos", "allele.*")


def fasta(allele: DataFrame) -> DataFrame:
    """file, pos, sequence_type, and a two-line FASTA record of each allele, without gaps."""
    return allele.select("file", "pos", "sequence_type", F.concat(F.lit(">"), "label", F.lit("\n"), without_gaps(F.col("coding_sequence"))).alias("record"))


def titles(allele: DataFrame) -> DataFrame:
    """sequence_type and its set titles in order of appearance, each once."""
    first = allele.groupBy("sequence_type", "title").agg(F.min(F.struct("file", "pos")).alias("at"))
    return first.groupBy("sequence_type").agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("t")).select("sequence_type", F.concat(F.lit(" "), F.array_join("t.title", "  ")).alias("title"))


def v_annotation(allele: DataFrame) -> DataFrame:
    """label, region bounds counted without gaps, chain and frame, for each IMGT delineation of V alleles.

    The first start is taken as it is; the last end counts gaps up to the end of the sequence.
    """
    rows = allele.where("sequence_type = 'V'").select("file", "pos", "label", "coding_sequence", "locus", "sequence_type", F.posexplode("v_gene_delineations").alias("dpos", "d")).where("lower(d.delineation_scheme) = 'imgt'")

    def less(name: str) -> Column:
        at = F.col(f"d.{name}")
        return (at - dot_count(F.col("coding_sequence"), at)).alias(name)

    inner = [less(c) for c in ("fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end", "cdr2_start", "cdr2_end", "fwr3_start", "fwr3_end")]
    chain = F.concat("sequence_type", F.expr("right(locus, 1)")).alias("chain")
    return rows.select("file", "pos", "dpos", "label", F.col("d.fwr1_start").alias("fwr1_start"), *inner, chain, F.lit(0).alias("frame"))
