"""One query for each operator that reads or prepares files: they are written to the shared folder first, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge.operators import germline as op
from cdrforge.plans.adapters import analysis, raw
from cdrforge.plans.queries import QUERIES as QUERIES, query
from cdrforge.sinks import ordered, reports
from cdrforge.sources import germline
from cdrforge.sources.airr import read_airr
from cdrforge.storage import Scratch


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """A folder of text files with the lines of one string column."""
    at = f"{Scratch(spark, 'files').base}/{name}"
    lines.write.text(at)
    return at


def _parts(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    return spark.sql(f"with p as (select p_partkey k, translate(concat(md5(cast(p_partkey as string)), md5(cast(p_partkey + 1 as string))), '0123456789abcdef', 'acgt.acgt.acgt..') s from {{part}}) {select}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))


@query
def airr_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a tab-separated table with more columns than are needed, and read again."""
    at = f"{Scratch(spark, 'files').base}/reads"
    plain = raw(spark, sf_dir).selectExpr("concat('R', read_id) sequence_id", "cdr3_end", "j_call", "'' d_call", "cdr3", "cdr3_aa", "cdr3_start", "v_call")
    plain.write.csv(at, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_airr(spark, at).select("cdr3", "cdr3_aa", "cdr_length", F.array_join("v_call", ",").alias("v_call"), F.array_join("j_call", ",").alias("j_call"))


@query
def airr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in files of three column orders, some of whose rows have a field too many, read by one pattern."""
    base = f"{Scratch(spark, 'files').base}/reads"
    orders = ["read_id, v_call, j_call, cdr3, cdr3_aa, cdr3_start, cdr3_end", "cdr3_end, d_call, cdr3_start, cdr3_aa, cdr3, j_call, v_call", "v_call, d_call, cdr3, j_call, read_id, cdr3_end, cdr3_aa, cdr3_start"]
    rows = raw(spark, sf_dir).withColumn("d_call", F.expr("case when read_id % 11 = 0 then 'D1\tD2' else '' end"))
    for k, columns in enumerate(orders):
        rows.where(F.col("read_id") % 3 == k).selectExpr(*columns.split(", ")).write.csv(f"{base}/run{k}", sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_airr(spark, f"{base}/run*").select("cdr3", "cdr3_aa", "cdr_length", F.array_join("v_call", ",").alias("v_call"), F.array_join("j_call", ",").alias("j_call"))


def _file(spark: SparkSession, name: str) -> str:
    """A file's place in the shared folder, with the scheme of its store."""
    scratch = Scratch(spark, "files")
    at, fs = scratch._at(f"{scratch.base}/{name}")
    return fs.makeQualified(at).toString()


@query
def lineage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage table as it is written, read again; lines of over 5 members come from several rows."""
    a, at = analysis(spark, sf_dir), _file(spark, "lineages.tsv")
    ordered.write_lineages(a.members, a.ranked, at, piece=5)
    return germline.result_table(spark, at, germline.LINEAGE_SCHEMA)


@query
def usage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _file(spark, "usage.tsv")
    ordered.write_usage(analysis(spark, sf_dir).usage, at)
    return germline.result_table(spark, at, germline.USAGE_SCHEMA)


@query
def weblogo_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the largest lineage as they are written, read again."""
    at = _file(spark, "weblogo.txt")
    ordered.write_weblogo(analysis(spark, sf_dir).weblogo, at)
    return spark.read.text(at).withColumnRenamed("value", "aa")


@query
def germline_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a reference tree with the species, locus and segment that their folders name."""
    scratch = Scratch(spark, "files")
    for k, place in enumerate(("Homo_sapiens/IG/IGHV", "Homo_sapiens/TR/TRBJ", "Mus_musculus/IG/IGKV")):
        _parts(spark, sf_dir, f"select concat('>A', k, '|', k % 7, '\n', s) line from p where k % 3 = {k}").write.text(f"{scratch.base}/tree/{place}.fasta")
    return germline.germline_records(spark, f"{scratch.base}/tree").drop("file")


@query
def imgt_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines to names, gaps out of all others."""
    header = "concat('>M', k, '|', case k % 3 when 0 then 'TRBV' else 'IGHV' end, k % 40, '*01|', case k % 4 when 0 then 'Mus  spretus' else 'Homo sapiens' end, '|F|V-REGION|1..9|9 nt|1| | | | |9+0=9| | |')"
    lines = _parts(spark, sf_dir, f"select explode(array({header}, s, concat('>odd.header|', k))) value from p")
    return op.rewrite_imgt(spark.read.text(_written(spark, lines, "imgt")))


_ENDS = "'fwr1_start', 1, 'fwr1_end', k % 5 + 3, 'cdr1_start', k % 5 + 4, 'cdr1_end', k % 5 + 9, 'fwr2_start', k % 5 + 10, 'fwr2_end', 20, 'cdr2_start', 21, 'cdr2_end', 30 + k % 3, 'fwr3_start', 33, 'fwr3_end', 60 + k % 9"
_MARK = "named_struct('delineation_scheme', '{}', " + _ENDS + ")"
_ALLELE = f"""named_struct('label', concat('A', k, '*01'), 'sequence_type', substr('VDJ', int(k % 3 + 1), 1), 'coding_sequence', s, 'locus', concat('IG', substr('HKL', int(k % 2 + 1), 1)),
  'v_gene_delineations', case k % 3 when 0 then case k % 2 when 0 then array({_MARK.format("IMGT")}, {_MARK.format("Kabat")}) else array({_MARK.format("imgt")}) end else array() end)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of five germline-set files; every other one holds a list, of which the first set counts."""
    one = f"to_json(named_struct('germline_set_name', concat('set ', g), 'germline_set_ref', concat('R.', g % 2), 'allele_descriptions', transform(array_sort(collect_list(struct(k, {_ALLELE} a))), x -> x.a)))"
    text = f"select g, case g % 2 when 0 then concat('{{\"GermlineSet\":\n[', o, ',', o, ']}}') else concat('{{\"GermlineSet\":\n', o, '}}') end line from (select k % 5 g, {one} o from p group by k % 5)"
    files = _parts(spark, sf_dir, text.replace("{", "{{").replace("}", "}}")).repartitionById(5, F.col("g").cast("int")).select("line")
    return op.alleles(germline.germline_sets(spark, _written(spark, files, "sets")))


@query
def germline_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("title", "pos", "label", "sequence_type", "locus", "coding_sequence", F.size("v_gene_delineations").alias("n_delineations"))


@query
def germline_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fasta(_sets(spark, sf_dir)).select("pos", "sequence_type", "record")


@query
def germline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.titles(_sets(spark, sf_dir))


@query
def germline_v_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.v_annotation(_sets(spark, sf_dir)).drop("file", "dpos")


@query
def germline_annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annotation_lines(op.v_annotation(_sets(spark, sf_dir))).select("pos", "line")


@query
def v_annotation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with tabs or runs of spaces, comments and blank lines."""
    numbers = ", ".join(f"'{{t}}', k * {n} % 97" for n in range(1, 11))
    line = f"concat('IGHV', k, '*01', {numbers}, '{{t}}V', substr('HK', int(k % 2 + 1), 1), '{{t}}0')"
    lines = f"select explode(array('#names', '', case k % 2 when 0 then {line.format(t='  ')} else {line.format(t=chr(9))} end)) value from p"
    return germline.v_annotation(spark, _written(spark, _parts(spark, sf_dir, lines), "annotation"))


@query
def j_auxiliary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line lacks the last two fields."""
    lines = "select concat('IGHJ', k, '*01\t', k % 3, '   JH', case k % 3 when 0 then '' else concat('\t', k % 50, '  ', k % 2, '   ') end) value from p union all select '# end'"
    return germline.j_auxiliary(spark, _written(spark, _parts(spark, sf_dir, lines), "auxiliary"))


@query
def d_frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = "select explode(array('#frames', concat('IGHD', k, '     ', k % 3))) value from p"
    return germline.d_frames(spark, _written(spark, _parts(spark, sf_dir, lines), "frames"))


@query
def blast_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select concat('{{\n \"dbname\": \"parts\",\n \"number-of-letters\": ', sum(length(s)), ',\n \"number-of-sequences\": ', count(*), '\n}}') value from p"
    got = germline.blast_metadata(spark, _written(spark, _parts(spark, sf_dir, text), "metadata"))
    return got.select("dbname", F.col("number-of-letters").alias("letters"), F.col("number-of-sequences").alias("sequences"))
