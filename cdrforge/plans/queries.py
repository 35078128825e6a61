"""One query for each operator, over reads derived from ``orders``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge.functions.genes import gene_calls, genes_overlap, smallest_common, strip_alleles
from cdrforge.functions.sequences import hamming_bytes, hamming_distance, imgt_gene, without_gaps
from cdrforge.operators import collapse, edge_sets, lineages, similarity
from cdrforge.plans.adapters import DENSE, analysis, donors, raw, reads
from cdrforge.plans.analysis import Analysis
from cdrforge.sinks.charts import placed
from cdrforge.sinks.reports import lineage_lines, stats_lines, usage_lines
from cdrforge.sources.germline import fasta_records as read_fasta
from cdrforge.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _joined(*names: str) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


@query
def scan_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select(F.col("ord").alias("read_id"), "cdr3", "cdr3_aa", "cdr_length", *_joined("v_call", "j_call"))


@query
def strip_allele_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("read_id", strip_alleles(F.col("v_call")).alias("v_stripped"), strip_alleles(F.col("j_call")).alias("j_stripped"))


@query
def gene_call_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).select("read_id", gene_calls(F.col("v_call")).alias("v_call")).select("read_id", F.size("v_call").cast("long").alias("n_genes"), *_joined("v_call"))


@query
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.load_summary(reads(spark, sf_dir))


@query
def unique_cdr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(reads(spark, sf_dir)).select("cdr3", "cdr_length", "n_reads", *_joined("v_call", "j_call"))


@query
def reads_per_cdr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.reads_per_cdr3(reads(spark, sf_dir))


@query
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.block_sizes(collapse.collapse(reads(spark, sf_dir)))


@query
def sequence_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each read to its reverse, by built-in functions and over bytes."""
    back = F.reverse("cdr3")
    return reads(spark, sf_dir).select(F.col("ord").alias("read_id"), hamming_distance(F.col("cdr3"), back).cast("long").alias("d_native"), hamming_bytes(F.col("cdr3"), back, 7).cast("long").alias("d_bytes"))


@query
def pigeonhole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = similarity.pigeonhole_chunks(collapse.collapse(reads(spark, sf_dir)))
    return nodes.select("cdr3", F.posexplode("chunks").alias("pos", "chunk"))


@query
def gene_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.array(F.lit("IGHV2"), F.lit("IGHV4"), F.lit("IGHV6"))
    return reads(spark, sf_dir).select(F.col("ord").alias("read_id"), genes_overlap(F.col("v_call"), fixed).alias("shared"), smallest_common(F.col("v_call"), fixed).alias("common"))


@query
def hamming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).edges


@query
def hamming_edges_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, DENSE).edges


@query
def hamming_edges_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.edges_by_definition(analysis(spark, sf_dir).nodes)


@query
def edge_sets_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's edges and the definition's."""
    a = analysis(spark, sf_dir)
    return edge_sets.equal(a.edges, similarity.edges_by_definition(a.nodes))


def _by_donor(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(donors(spark.read.parquet(f"{sf_dir}/orders.parquet")), by=("donor",))


@query
def donor_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of five donors, whose reads share sequences."""
    return _by_donor(spark, sf_dir).ranked.select("donor", "lineage", "root", "n_unique_cdr3", "n_reads")


@query
def donor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_donor(spark, sf_dir).stats.select("donor", "metric", "value")


@query
def donor_v_gene_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_donor(spark, sf_dir).usage


@query
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).graph


@query
def clonal_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).ranked.drop("component")


@query
def clonal_lineages_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir, DENSE).ranked.drop("component")


@query
def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).table.select("lineage", "n_unique_cdr3", "n_reads", *_joined("cdr3s"))


@query
def lineage_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).summaries.select("root", "n_reads")


@query
def largest_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineages.largest(analysis(spark, sf_dir).summaries).drop("component")


@query
def lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).stats.select("metric", "value")


@query
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_lines(analysis(spark, sf_dir).stats).select("line")


@query
def lineage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_lines(analysis(spark, sf_dir).table)


@query
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_lines(analysis(spark, sf_dir).usage)


@query
def rank_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).ranked.select((F.col("lineage") + 1).alias("rank"), "n_unique_cdr3", "n_reads")


@query
def v_gene_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).usage.orderBy("v_gene")


@query
def v_gene_usage_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the bar's place: there are as many rows as genes."""
    usage = analysis(spark, sf_dir).usage
    return usage.withColumn("bar", F.expr("row_number() over (order by reads desc, v_gene)").cast("long")).orderBy("bar")


@query
def top_v_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).usage.orderBy(F.desc("reads"), "v_gene").limit(6)


@query
def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage chart's bars as they are placed and coloured: as many rows as there are genes."""
    bars = [(f"{r['v_gene']} & <{r['reads']}>", float(r["reads"])) for r in analysis(spark, sf_dir).usage.orderBy("v_gene").collect()]
    return spark.createDataFrame(placed(bars), "place int, name string, share double, colour string, bound double")


@query
def weblogo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).weblogo.select(F.col("ord").alias("read_id"), "aa")


@query
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as wrapped FASTA with IMGT headers, read again, headers and gaps rewritten."""
    half = F.floor(F.length("cdr3") / 2).cast("int")
    body = F.concat(F.substring("cdr3", F.lit(1), half), F.lit("...\n"), F.expr("substring(cdr3, length(cdr3) div 2 + 1)"))
    head = F.concat(F.lit(">R"), "ord", F.lit("|"), F.array_join("j_call", ","), F.lit("|Mus spretus|F|V-REGION|1..9|9 nt|1| | | | |9+0=9| | |"))
    scratch = Scratch(spark, "fasta")
    reads(spark, sf_dir).select(F.concat(head, F.lit("\n"), body).alias("value")).write.text(f"{scratch.base}/records")
    got = read_fasta(spark, f"{scratch.base}/records")
    return got.select(F.regexp_extract("header", r"^([^|]*)", 1).alias("accession"), imgt_gene(F.concat(F.lit(">"), "header")).alias("gene"), without_gaps(F.col("sequence")).alias("sequence"))
