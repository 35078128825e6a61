"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then re-reads files instead of recomputing, and nothing depends on
blocks that exist once only.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, or one of our own where it names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/checkpoints/cdrforge-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_bases: dict[str, tuple] = {}


def clean() -> None:
    """Remove the tables of all operators that have run. Results that read them must have been written or collected before."""
    while _bases:
        _remove(*_bases.popitem()[1])


def _remove(at, fs) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and then nobody can
        fs.delete(at, True)


class Scratch:
    """Tables of one operator run, below a folder of its own that goes when the application ends, or with ``clean``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not _bases:  # after the gateway's own handler, and so before it at exit
            atexit.unregister(clean)
            atexit.register(clean)
        _bases[self.base] = self._at(self.base)

    def _at(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> str:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return path

    def write_counted(self, df: DataFrame, name: str) -> tuple[str, int]:
        """The path and the number of rows, which the same job counts."""
        seen = Observation()
        path = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return path, seen.get["n"]

    def read(self, path: str, df: DataFrame) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and give the table read back."""
        return self.read(self.write(df, name), df)

    def drop(self, path: str) -> None:
        """Remove a table that nothing reads any more."""
        at, fs = self._at(path)
        fs.delete(at, True)
