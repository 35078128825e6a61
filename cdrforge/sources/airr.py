"""AIRR rearrangement tables (tab-separated, with a header)."""

from __future__ import annotations

import csv
import functools
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cdrforge.functions.genes import gene_calls
from cdrforge.functions.sequences import reported_length

#: In the order in which a missing one is reported.
REQUIRED = ("v_call", "j_call", "cdr3", "cdr3_aa", "cdr3_start", "cdr3_end")


def require_columns(columns: list[str], path: str) -> None:
    for name in REQUIRED:
        if name not in columns:
            raise ValueError(f"Column '{name}' missing from {path}")


def require_file(spark: SparkSession, path: str) -> None:
    """Any store that Spark reads; patterns may match several files."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or not len(found):
        raise FileNotFoundError(f"Input file '{path}' does not exist.")


def normalise(raw: DataFrame, ordinal: Column, by: Sequence[str] = ()) -> DataFrame:
    """Reads: ord, the columns ``by``, cdr3, cdr3_aa, cdr_length, v_call, j_call. Of the input only the required columns are read.

    Blank sequences are empty strings and legitimate; blank calls have no genes; a
    coordinate that is not an integer is an error.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        ordinal.alias("ord"), *by, text("cdr3").alias("cdr3"), text("cdr3_aa").alias("cdr3_aa"), reported_length(F.col("cdr3_start"), F.col("cdr3_end")).alias("cdr_length"),
        gene_calls(F.col("v_call")).alias("v_call"), gene_calls(F.col("j_call")).alias("j_call"),
    )


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path, folder or pattern by the column names in their first line; blank lines before it and files without a line don't count.

    One pass over the files' first blocks. The driver sees their names, as it does when it lists them.
    """
    first = spark.read.text(path).where("_metadata.file_block_start = 0 and trim(value) <> ''")
    first = first.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"), "value")
    heads = first.groupBy("file").agg(F.min_by("value", "i").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(heads.collect(), key=lambda r: r["files"]):
        out.setdefault(tuple(next(csv.reader([r["head"].removeprefix("\ufeff").rstrip("\r")], delimiter="\t"))), []).extend(map(unquote, r["files"]))
    return out


def read_airr(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a file, a folder or a pattern; their order is that of path, block and row.

    Each file's own header says where its columns stand; files of the same header are
    one scan. A row with more or fewer fields than its header is dropped; a coordinate
    that is not an integer is an error, as is a file that lacks a required column.
    """
    require_file(spark, path)
    found = headers(spark, path)
    if not found:
        require_columns([], path)
    scans = []
    for names, files in found.items():
        require_columns(list(names), files[0] if len(found) > 1 else path)
        # names may occur twice: the first one counts, and fields go by their place
        kind = ", ".join(f"c{k} string" for k in range(len(names)))
        raw = spark.read.option("columnPruning", "false").csv(files, schema=kind, sep="\t", header=True, escape='"', mode="DROPMALFORMED", enforceSchema=True)
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
        scans.append(raw.select(place.alias("place"), *(F.col(f"c{names.index(c)}").alias(c) for c in REQUIRED)))
    return normalise(functools.reduce(DataFrame.unionByName, scans), F.col("place"))
