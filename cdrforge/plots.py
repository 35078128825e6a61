"""Figures of a finished analysis: ``python -m cdrforge.plots [folder of the tables] [folder of the figures]``.

The folder holds ``v_gene_usage.tsv`` and ``lineages.tsv``.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from cdrforge.session import session
from cdrforge.sinks import charts, reports
from cdrforge.sources.airr import require_file
from cdrforge.sources.germline import LINEAGE_SCHEMA, USAGE_SCHEMA, result_table


def abundance_points(lineages: DataFrame, most: int = 400) -> dict[str, list[tuple[int, int]]]:
    """(rank, count) by reads and by unique CDR3s, at ``most`` ranks or fewer that a logarithmic axis can tell apart."""
    last = (lineages.agg(F.max("lineage")).first()[0] or 0) + 1
    ranks = sorted({round(last ** (k / (most - 1))) for k in range(most)})
    rows = lineages.where((F.col("lineage") + 1).isin(ranks)).select((F.col("lineage") + 1).alias("rank"), "n_reads", "n_unique_cdr3").orderBy("rank").collect()
    return {name: [(r["rank"], r[c]) for r in rows] for name, c in (("reads", "n_reads"), ("unique CDR3s", "n_unique_cdr3"))}


def main(argv: list[str]) -> int:
    source, target = [*argv, "out", "out"][:2] if len(argv) != 1 else [argv[0], "out"]
    spark = session()
    usage, lineages = (f"{source}/{name}.tsv" for name in ("v_gene_usage", "lineages"))
    for path in (usage, lineages):
        require_file(spark, path)
    bars = [(r["v_gene"], float(r["reads"])) for r in result_table(spark, usage, USAGE_SCHEMA).orderBy("v_gene").collect()]  # as many as there are genes
    reports.write_file(Path(target) / "v_gene_usage.svg", [charts.columns("V Gene Usage Statistics", "V genes", "reads", bars)])
    points = abundance_points(result_table(spark, lineages, LINEAGE_SCHEMA))
    reports.write_file(Path(target) / "lineage_rank_abundance.svg", [charts.abundance("Lineages by rank", points)])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
