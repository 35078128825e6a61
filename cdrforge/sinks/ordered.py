"""One text file from tables of any size: tasks write ranges of it in order, and their files are joined byte by byte.

Nothing of a table passes the driver's memory; where the file is on the driver's own
disk, its bytes are copied there in pieces. A line that is too long for a row, such as
that of a lineage with millions of members, is written from many rows: Spark's text
writer ends rows with a separator of one's choice, so the text before the last piece of
the last such line is written with commas as ends, and all that follows with line ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge.sinks.reports import LINEAGE_HEADER, USAGE_HEADER, annotation_lines, usage_lines
from cdrforge.storage import Scratch

#: Long lines whose heads are broadcast at most; more are joined.
_HEADS = 100_000


def _parts(spark: SparkSession, folder: str) -> list[tuple]:
    """Streams of a written folder's files in order, and their lengths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()]
    return [(fs, f.getPath(), f.getLen()) for f in sorted(found, key=lambda f: f.getPath().getName())]


def _open(spark: SparkSession, path: str):
    """A stream to write to: a plain path is one of the driver's own disk. Folders are made."""
    jvm = spark.sparkContext._jvm
    if "://" in path or path.startswith("file:"):
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb"):  # the error of an unwritable path is Python's
        pass
    return jvm.java.io.BufferedOutputStream(jvm.java.io.FileOutputStream(path))


def write_text(spark: SparkSession, path: str | Path, head: str, tables: Sequence[tuple[DataFrame, str]], last_end: bool = True) -> None:
    """``head``, and then the one text column of each (sorted) table with its separator after each row; without ``last_end`` the very last separator is left out."""
    scratch = Scratch(spark, "text")
    parts = []
    for k, (table, end) in enumerate(tables):
        table.write.option("lineSep", end).text(f"{scratch.base}/{k}")
        parts += _parts(spark, f"{scratch.base}/{k}")
    jvm, out = spark.sparkContext._jvm, _open(spark, str(path))
    try:
        out.write(head.encode())
        for k, (fs, at, size) in enumerate(parts):
            stream = fs.open(at)
            if not last_end and k == len(parts) - 1:
                stream = jvm.org.apache.commons.io.input.BoundedInputStream(stream, size - 1)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()
    scratch.drop(scratch.base)


def lineage_tables(member: DataFrame, ranked: DataFrame, piece: int = 10_000) -> list[tuple[DataFrame, str]]:
    """The lineage table's text in tables of a bounded row: no row holds more than 2 ``piece`` members.

    ``member``: component, cdr3. ``ranked``: lineage, component, n_unique_cdr3, n_reads.
    Lineages come by size, so those of more than ``piece`` members come first.
    """
    scratch = Scratch(member.sparkSession, "lines")
    heads = scratch.table(ranked.select("lineage", "component", "n_unique_cdr3", F.concat_ws("\t", "lineage", "n_unique_cdr3", "n_reads", F.lit("")).alias("head")), "heads")
    large = heads.where(F.col("n_unique_cdr3") > piece)
    n = large.count()
    few = F.broadcast(large) if n <= _HEADS else large
    member = member.select("component", "cdr3")
    small = member.join(few.select("component"), "component", "left_anti").join(heads.where(F.col("n_unique_cdr3") <= piece), "component")
    lines = small.groupBy("lineage", "head").agg(F.array_sort(F.collect_list("cdr3")).alias("m")).select("lineage", F.concat("head", F.array_join("m", ",")).alias("text"))
    if not n:
        return [(lines.orderBy("lineage").select("text"), "\n")]
    # sorted over ranges; a member's place is that in its range and the rows of the ranges before
    rows = member.join(few.select("component", "lineage"), "component").select("lineage", "cdr3").orderBy("lineage", "cdr3").withColumn("i", F.monotonically_increasing_id())
    rows = scratch.table(rows, "sorted").withColumn("part", F.shiftright("i", 33))
    counts = rows.groupBy("part").agg(F.count("*").alias("c"))  # a row for each partition
    before = counts.withColumn("before", F.expr("sum(c) over (order by part rows between unbounded preceding and current row) - c"))
    rows = rows.join(F.broadcast(before), "part").select("lineage", "cdr3", (F.col("before") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))
    first = rows.groupBy("lineage").agg(F.min("place").alias("first"))
    rows = rows.join(F.broadcast(first) if n <= _HEADS else first, "lineage").withColumn("k", F.expr(f"(place - first) div {piece}"))
    pieces = rows.groupBy("lineage", "k").agg(F.array_join(F.array_sort(F.collect_list("cdr3")), ",").alias("text"))
    # a line's first piece stands in one row with the last one of the line before: between them is a line end and no comma
    ends = large.select("lineage", "head", F.expr(f"(n_unique_cdr3 - 1) div {piece}").alias("last"))
    shift = ends.select((F.col("lineage") + 1).alias("lineage"), F.col("last").alias("last_before"))
    ends = ends.join(shift, "lineage", "left")
    pieces = pieces.join(F.broadcast(ends) if n <= _HEADS else ends, "lineage")
    opens = (F.col("k") == 0) & (F.col("lineage") > 0)
    pieces = pieces.select(
        F.when(opens, F.col("lineage") - 1).otherwise(F.col("lineage")).alias("lineage"), F.when(opens, F.col("last_before")).otherwise(F.col("k")).alias("k"), opens.alias("second"),
        F.concat(F.when(opens, "\n").otherwise(""), F.when(F.col("k") == 0, F.col("head")).otherwise(""), "text").alias("text"), ((F.col("lineage") == n - 1) & (F.col("k") == F.col("last"))).alias("closes"),
    )
    pieces = scratch.table(pieces, "pieces")
    joined = pieces.where("not closes").groupBy("lineage", "k").agg(F.array_sort(F.collect_list(F.struct("second", "text"))).alias("t"))
    commas = joined.select("lineage", "k", F.array_join("t.text", "").alias("text")).orderBy("lineage", "k")
    lines = lines.unionByName(pieces.where("closes").select("lineage", "text"))
    return [(commas.select("text"), ","), (lines.orderBy("lineage").select("text"), "\n")]


def write_lineages(member: DataFrame, ranked: DataFrame, path: str | Path, piece: int = 10_000) -> None:
    write_text(member.sparkSession, path, LINEAGE_HEADER + "\n", lineage_tables(member, ranked, piece))


def write_usage(usage: DataFrame, path: str | Path) -> None:
    write_text(usage.sparkSession, path, USAGE_HEADER + "\n", [(usage_lines(usage).orderBy("v_gene").select("line"), "\n")])


def write_weblogo(rows: DataFrame, path: str | Path) -> None:
    """One line per read, without a line end after the last."""
    write_text(rows.sparkSession, path, "", [(rows.orderBy("ord").select("aa"), "\n")], last_end=False)


def write_annotation(rows: DataFrame, path: str | Path) -> None:
    write_text(rows.sparkSession, path, "", [(annotation_lines(rows).orderBy("file", "pos", "dpos").select("line"), "\n")])


def write_fasta(records: DataFrame, prefix: str) -> list[str]:
    """``prefix.V``, ``.D`` and ``.J`` of the records there are; a segment without any gets no file."""
    some = {r["sequence_type"] for r in records.select("sequence_type").distinct().collect()}
    written = []
    for segment in (s for s in "VDJ" if s in some):
        rows = records.where(F.col("sequence_type") == segment).orderBy("file", "pos").select("record")
        write_text(records.sparkSession, f"{prefix}.{segment}", "", [(rows, "\n")])
        written.append(f"{prefix}.{segment}")
    return written
