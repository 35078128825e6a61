"""Lineages, members, V gene usage and statistics of each donor, from all reads that the donor has.

    python -m jobs.donor_repertoires --orders /data/orders.parquet --out /data/repertoires
    python -m jobs.donor_repertoires --airr '/data/runs/*/reads.tsv' --out /data/repertoires --only D1 D2

Four tables below ``--out``, each partitioned by donor: ``lineages``, ``members``,
``usage`` and ``stats``. Partitions are overwritten one by one (dynamic partition
overwrite), so a run can be repeated, or limited to some donors, and all other donors
keep what they have.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge import logs
from cdrforge.operators import lineages
from cdrforge.plans.adapters import donors
from cdrforge.plans.analysis import Analysis
from cdrforge.session import session
from cdrforge.sources.airr import read_airr
from jobs.config import load

TABLES = ("lineages", "members", "usage", "stats")


def orders_reads(spark: SparkSession, path: str, n: int) -> DataFrame:
    return donors(spark.read.parquet(path), n)


def airr_reads(spark: SparkSession, pattern: str) -> DataFrame:
    """Reads of AIRR tables whose folder is named like its donor."""
    return read_airr(spark, pattern).withColumn("donor", F.regexp_extract("ord.file", r"([^/]+)/[^/]+$", 1))


def run(reads: DataFrame, out: str, settings: dict[str, Any], only: list[str] | None = None) -> dict[str, int]:
    """Writes the tables and returns the rows of each; ``reads`` have a column ``donor``.

    A null donor is a partition of its own. Without reads nothing is written.
    """
    if only:
        reads = reads.where(F.col("donor").isin(only))
    a = Analysis(reads, settings["ratio"], settings["min_lineage_size"], ("donor",))
    for r in a.loaded.orderBy("donor").collect():  # as many as there are donors
        logs.log.info("Donor %s: read %d sequences (%d unique CDR3s).", r["donor"], r["n_reads"], r["n_unique_cdr3"])
    tables = {
        "lineages": a.ranked.select("donor", "lineage", "root", "n_unique_cdr3", "n_reads"),
        "members": lineages.numbered(a.members, ("donor",), a.ranked).select("donor", "lineage", "cdr3", "n_reads"),
        "usage": a.usage,
        "stats": a.stats.select("donor", "ord", "metric", "value"),
    }
    written = {}
    for name, table in tables.items():
        # a donor may hold a third of all rows: several files each, dealt by row
        dealt = table.repartition("donor", F.expr(f"pmod(xxhash64({', '.join(c for c in table.columns if c != 'donor')}), {settings['files_per_donor']})"))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("donor").parquet(f"{out}/{name}")
        written[name] = table.sparkSession.read.schema(table.schema).parquet(f"{out}/{name}").count()
        logs.log.info("Table %s holds %d rows at %s/%s", name, written[name], out, name)
    return written


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="donor_repertoires", description=__doc__.splitlines()[0])
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--orders", metavar="PATH", help="orders table from which reads are derived")
    source.add_argument("--airr", metavar="PATTERN", help="AIRR tables, each in a folder named like its donor")
    p.add_argument("--out", required=True, metavar="PATH")
    p.add_argument("--only", nargs="+", metavar="DONOR", help="donors to write; the others stay as they are")
    p.add_argument("--config", metavar="FILE", help="JSON with other settings than donor_repertoires.json")
    o = p.parse_args(argv)
    logs.configure()
    settings = load("donor_repertoires", o.config)
    spark = session()
    try:
        run(orders_reads(spark, o.orders, settings["donors"]) if o.orders else airr_reads(spark, o.airr), o.out, settings, o.only)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
