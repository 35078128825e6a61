"""Germline data: FASTA, annotation and auxiliary tables, germline sets, database metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """file, header (without ``>``), sequence (lines joined) of every record; folders are searched in depth."""
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(r, length(h) + 1)"), r"[\r\n]", "")
    return raw.select(F.col("_metadata.file_path").alias("file"), record.alias("r")).withColumn("h", F.regexp_extract("r", r"^([^\r\n]*)", 1)).where("trim(r) <> ''").select("file", F.col("h").alias("header"), body.alias("sequence"))


def germline_records(spark: SparkSession, path: str) -> DataFrame:
    """file, species, locus and segment, header, sequence of a reference tree ``<species>/<IG or TR>/<locus><segment>.fasta``; null for files that stand elsewhere."""
    part = lambda k: F.nullif(F.regexp_extract("file", r"/([^/]+)/(?:IG|TR)/([A-Z]{3})([A-Z])\.fasta(?:/|$)", k), F.lit(""))
    return fasta_records(spark, path).select("file", F.replace(part(1), F.lit("_"), F.lit(" ")).alias("species"), part(2).alias("locus"), part(3).alias("segment"), "header", "sequence")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Fields of lines that are neither blank nor comments; tabs and runs of spaces part them alike."""
    return spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"))


def _field(k: int, kind: str = "string") -> Column:
    return F.try_element_at("f", F.lit(k)).cast(kind)


V_REGIONS = [f"{r}_{e}" for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3") for e in ("start", "stop")]


def v_annotation(spark: SparkSession, path: str) -> DataFrame:
    """V regions: name, start and stop of five regions, chain, frame."""
    return _fields(spark, path).select(_field(1).alias("name"), *(_field(k + 2, "int").alias(c) for k, c in enumerate(V_REGIONS)), _field(12).alias("chain"), _field(13).alias("frame"))


def j_auxiliary(spark: SparkSession, path: str) -> DataFrame:
    """J genes: name, frame, chain and, where given, cdr3_stop and extra_bp."""
    return _fields(spark, path).select(_field(1).alias("name"), _field(2, "int").alias("frame"), _field(3).alias("chain"), _field(4, "int").alias("cdr3_stop"), _field(5, "int").alias("extra_bp"))


def d_frames(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_field(1).alias("name"), _field(2, "int").alias("start"))


_REGION = ", ".join(f"{c}: int" for c in ("fwr1_start", "fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end", "cdr2_start", "cdr2_end", "fwr3_start", "fwr3_end"))
_SET = f"struct<germline_set_name: string, germline_set_ref: string, allele_descriptions: array<struct<label: string, sequence_type: string, coding_sequence: string, locus: string, v_gene_delineations: array<struct<delineation_scheme: string, {_REGION}>>>>>"


def germline_sets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and set (of a list of sets the first) of germline-set JSON files; a string may name several, parted by spaces."""
    paths = paths.split() if isinstance(paths, str) else paths
    many = spark.read.schema(f"GermlineSet array<{_SET}>").json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.col("GermlineSet")[0].alias("set"))
    one = spark.read.schema(f"GermlineSet {_SET}").json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.col("GermlineSet").alias("set"))
    return many.where("set is not null").unionByName(one.where("set.allele_descriptions is not null"))


def blast_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def result_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lineage or usage table read again."""
    try:
        return spark.read.csv(path, sep="\t", header=True, schema=schema)
    except AnalysisException as e:
        raise FileNotFoundError(f"Input file '{path}' does not exist.") from e


LINEAGE_SCHEMA = "lineage long, n_unique_cdr3 long, n_reads long, cdr3s string"
USAGE_SCHEMA = "v_gene string, reads long"
