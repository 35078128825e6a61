"""Whether two lists of undirected edges hold the same edges equally often."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fingerprint(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """One row: n, and the sums of two independent 64-bit hashes of each edge.

    It does not depend on the order of edges or of an edge's ends, and counts repeated
    edges each time; a null end is a value like others. A partial aggregate, without a
    sort. Different lists of edges have the same sums with a chance of about 2 ** -128.
    """
    low, high = F.least(u, v), F.greatest(u, v)
    one_null = F.when(F.col(u).isNull() | F.col(v).isNull(), F.coalesce(u, v))  # least and greatest skip nulls
    ends = (low, F.when(one_null.isNull(), high), F.col(u).isNull() | F.col(v).isNull())
    # the second hash begins with another value: a hash of (edge, 1) would only be one of the first hash
    sums = [F.coalesce(F.sum(F.xxhash64(*seed, *ends).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)") for seed in ((), (F.lit(1),))]
    return edges.select(u, v).agg(F.count("*").alias("n"), sums[0].alias("h1"), sums[1].alias("h2"))


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """n_left, n_right, equal: one row. Both name their ends a and b."""
    rows = fingerprint(left).select(F.struct("*").alias("l")).crossJoin(fingerprint(right).select(F.struct("*").alias("r")))  # one row each
    return rows.select(F.col("l.n").alias("n_left"), F.col("r.n").alias("n_right"), (F.col("l") == F.col("r")).alias("equal"))
