"""Lines of text reports, byte for byte: LF ends, no quoting."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from cdrforge.functions.sequences import group_digits, left_pad

LINEAGE_HEADER = "lineage\tn_unique_cdr3\tn_reads\tcdr3s"
USAGE_HEADER = "v_gene\treads"


def write_file(path: str | Path, chunks: Iterable[str]) -> None:
    """Folders are made; an unwritable path is an error."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    with at.open("w", encoding="utf-8", newline="") as f:
        f.writelines(chunks)


def stats_lines(stats: DataFrame) -> DataFrame:
    """ord, line: the value right-aligned in eight columns, two spaces, the metric."""
    return stats.select("ord", F.concat(left_pad(group_digits(F.col("value")), 8), F.lit("  "), "metric").alias("line"))


def stats_text(stats: DataFrame) -> str:
    return "".join(f"{r['line']}\n" for r in stats_lines(stats).orderBy("ord").collect())


def lineage_lines(table: DataFrame) -> DataFrame:
    """lineage, line: a lineage's row of the table."""
    return table.select("lineage", F.concat_ws("\t", "lineage", "n_unique_cdr3", "n_reads", F.array_join("cdr3s", ",")).alias("line"))


def usage_lines(usage: DataFrame) -> DataFrame:
    """v_gene, line."""
    return usage.select("v_gene", F.concat_ws("\t", "v_gene", "reads").alias("line"))


def annotation_lines(rows: DataFrame) -> DataFrame:
    """file, pos, dpos, line."""
    columns = [c for c in rows.columns if c not in ("file", "pos", "dpos")]
    return rows.select("file", "pos", "dpos", F.concat_ws("\t", *columns).alias("line"))
