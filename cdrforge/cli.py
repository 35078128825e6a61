"""Command line: lineages of an AIRR table, as a report on stdout and optional files."""

from __future__ import annotations

import argparse
import logging
import re
import sys

from cdrforge import logs
from cdrforge.plans.analysis import Analysis
from cdrforge.session import session
from cdrforge.sinks import charts, ordered, reports
from cdrforge.sources.airr import read_airr


def _int(text: str) -> int:
    if not (m := re.match(r"\s*([+-]?\d+)", text)):
        raise argparse.ArgumentTypeError(f"not a number: {text}")
    return int(m[1])


def _float(text: str) -> float:
    if not (m := re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text)):
        raise argparse.ArgumentTypeError(f"not a number: {text}")
    return float(m[0])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cdrforge", description="Clonal lineages of antibody reads.", allow_abbrev=False)
    add = p.add_argument
    add("--igblast", required=True, metavar="PATH", help="AIRR table of aligned reads")
    add("--dump-lineages", metavar="PATH", default="", help="write all lineages as a table")
    add("--dump-usage", metavar="PATH", default="", help="write V gene usage as a table")
    add("--weblogo-query", metavar="PATH", default="", help="write the amino acids of the largest lineage")
    add("--usage-plot", metavar="PATH", default="", help="draw V gene usage (SVG)")
    add("--stats-plot", metavar="PATH", default="", help="draw lineage statistics (SVG)")
    add("--workers", type=_int, default=0, help="local cores; 0: all")
    add("--threshold", type=_float, default=0.1, help="differing share of the CDR3 at most")
    add("--min-lineage-size", type=_int, default=10, help="size from which lineages are counted apart")
    add("--log-file", metavar="PATH", default="", help="append log lines to a file")
    add("--log-level", default="INFO", help="DEBUG, INFO, WARNING or ERROR")
    return p


def run(o: argparse.Namespace) -> None:
    spark = session(o.workers)
    a = Analysis(read_airr(spark, o.igblast), o.threshold, o.min_lineage_size)
    if logs.log.isEnabledFor(logging.INFO):  # they cost a pass over the reads and one over the edges
        loaded, graph = a.loaded.first(), a.graph.first()
        logs.log.info("Loaded %d sequences (%d unique CDR3s).", loaded["n_reads"], loaded["n_unique_cdr3"])
        logs.log.info("Hamming graph: %d nodes, %d edges, %d blocks scanned on %d worker(s).", graph["n_nodes"], graph["n_edges"], graph["n_blocks"], spark.sparkContext.defaultParallelism)
    sys.stdout.write(reports.stats_text(a.stats))
    if o.dump_lineages:
        ordered.write_lineages(a.members, a.ranked, o.dump_lineages)
    if o.dump_usage:
        ordered.write_usage(a.usage, o.dump_usage)
    if o.usage_plot:
        bars = [(r["v_gene"], float(r["reads"])) for r in a.usage.orderBy("v_gene").collect()]  # as many as there are genes
        reports.write_file(o.usage_plot, [charts.columns("V Gene Usage Statistics", "V genes", "reads", bars)])
        logs.log.info("Plot written to %s", o.usage_plot)
    if o.stats_plot:
        bars = [(r["metric"], float(r["value"])) for r in a.stats.orderBy("ord").collect()]
        reports.write_file(o.stats_plot, [charts.rows("Clonal Lineage Statistics", "value", bars)])
        logs.log.info("Plot written to %s", o.stats_plot)
    if o.weblogo_query:
        if a.summaries.isEmpty():
            logs.log.warning("No lineages: the WebLogo query is empty.")
        ordered.write_weblogo(a.weblogo, o.weblogo_query)
    logs.log.info("Analysis complete.")


def main(argv: list[str] | None = None) -> int:
    """0, 2 for wrong arguments, 1 for any failure of the run."""
    try:
        o = parser().parse_args(argv)
        logs.configure(o.log_level, o.log_file)
    except SystemExit as e:
        return int(e.code or 0)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}\n\n{parser().format_help()}", file=sys.stderr)
        return 2
    try:
        run(o)
    except Exception as e:  # noqa: BLE001  whatever it is, it is logged and ends the run
        logs.log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
