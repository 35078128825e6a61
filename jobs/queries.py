"""The jobs as queries: run twice over the whole tables into a new folder, and what the output then holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cdrforge.plans import oracle
from cdrforge.storage import scratch_root
from jobs import clone_catalogue, donor_repertoires
from jobs.config import load


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of this call alone; its files stay."""
    return f"{scratch_root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_donor_repertoires(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, settings = _folder(spark, "donor_repertoires"), load("donor_repertoires")
    for _ in range(2):
        donor_repertoires.run(donor_repertoires.orders_reads(spark, f"{sf_dir}/orders.parquet", settings["donors"]), out, settings)
    return spark.read.parquet(f"{out}/lineages").select("donor", "lineage", "root", "n_unique_cdr3", "n_reads")


def job2_clone_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "clone_catalogue")
    for _ in range(2):
        clone_catalogue.run(spark, f"{sf_dir}/documents.parquet", f"{out}/catalogue", f"{out}/checkpoint", load("clone_catalogue"))
    return clone_catalogue.table(spark, f"{out}/catalogue/lineages", clone_catalogue.LINEAGES)


QUERIES = {f.__name__: f for f in (job1_donor_repertoires, job2_clone_catalogue)}
SQL = {"job1_donor_repertoires": oracle.DONOR_LINEAGES, "job2_clone_catalogue": oracle.TEXT_LINEAGES}
