"""Clonal lineages: components of the similarity graph, in a total order.

``by`` names columns, such as a donor, whose values are kept apart: lineages don't
cross them, and ranks, largest ones and statistics are those of each value.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cdrforge.operators.components import connected_components
from cdrforge.operators.semi_join import semi_join
from cdrforge.storage import Scratch


def members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``component``, the smallest key of its component; a node without an edge is its own.

    The key that edges name is ``id`` where nodes have one, else ``cdr3``.
    """
    key = "id" if "id" in nodes.columns else "cdr3"
    label = connected_components(edges.select("a", "b"), "lineages", one_task_rows=200_000, task_rows=500_000)
    return nodes.join(label, nodes[key] == label["node"], "left").withColumn("component", F.coalesce("component", key)).drop("node")


def _sizes() -> list:
    return [F.min("cdr3").alias("root"), F.count("*").alias("n_unique_cdr3"), F.sum("n_reads").alias("n_reads")]


def summaries(member: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """component, root (its smallest sequence), n_unique_cdr3, n_reads of each lineage."""
    return member.groupBy(*by, "component").agg(*_sizes())


def _renamed(df: DataFrame, by: Sequence[str], *others: Column) -> DataFrame:
    """The columns of ``by`` under names of their own, and others."""
    return df.select(*(F.col(c).alias(f"__{c}") for c in by), *others)


def _same(by: Sequence[str]) -> Column:
    """Null is a value like others."""
    return functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))


def ranked(lineages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """lineages with ``lineage``: 0 for the most unique CDR3s, ties by root.

    They are sorted over ranges and written; a row's number is its place in its
    partition and the rows of the partitions before, so no task sees all lineages.
    """
    place = lineages.orderBy(*by, F.desc("n_unique_cdr3"), "root").withColumn("i", F.monotonically_increasing_id())
    placed = Scratch(lineages.sparkSession, "ranks").table(place, "sorted").withColumn("part", F.shiftright("i", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("c"))  # a row for each partition
    before = counts.withColumn("before", F.expr("sum(c) over (order by part rows between unbounded preceding and current row) - c"))
    number = F.col("before") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(before), "part").select(number.alias("lineage"), *lineages.columns)
    if by:
        first = _renamed(out.groupBy(*by).agg(F.min("lineage").alias("first")), by, F.col("first").alias("__first"))
        out = out.join(first, _same(by)).select((F.col("lineage") - F.col("__first")).alias("lineage"), *lineages.columns)
    return out


def table(member: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """lineage, n_unique_cdr3, n_reads, cdr3s (sorted array) of each lineage; not sorted by lineage.

    A row holds all members; ``numbered`` has a row for each.
    """
    listed = member.groupBy(*by, "component").agg(*_sizes(), F.array_sort(F.collect_list("cdr3")).alias("cdr3s"))
    return ranked(listed, by).select(*by, "lineage", "n_unique_cdr3", "n_reads", "cdr3s")


def numbered(member: DataFrame, by: Sequence[str] = (), ranks: DataFrame | None = None) -> DataFrame:
    """member with ``lineage``, the rank of its lineage; ``ranks``: what ``ranked`` gives for its lineages, where that is known."""
    rank = _renamed(ranked(summaries(member, by), by) if ranks is None else ranks, by, F.col("lineage"), F.col("component").alias("__c"))
    return member.join(rank, (F.col("component") == F.col("__c")) & _same(by)).select("lineage", *member.columns)


def largest(lineages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The one row of the lineage with the most unique CDR3s (ties: smallest root); none if there is no lineage."""
    top = lineages.groupBy(*by).agg(F.min(F.struct((-F.col("n_unique_cdr3")).alias("neg"), "root", "n_reads", "component")).alias("t")).where("t is not null")
    return top.select(*by, "t.root", (-F.col("t.neg")).alias("n_unique_cdr3"), "t.n_reads", "t.component")


def metric_names(least: int) -> list[str]:
    """The names that reports carry."""
    return [
        "number of clonal lineages",
        "number of unique CDR3s in the largest clonal lineage",
        "number of sequences in the largest clonal lineage",
        f"number of lineages represented by at least {least} unique CDR3s",
        f"number of lineages represented by at least {least} sequences",
    ]


def stats(lineages: DataFrame, least: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """ord, metric, value: five rows, all 0 without lineages (with ``by``: five rows for each value that occurs). One pass of partial sums."""
    top = F.min(F.struct((-F.col("n_unique_cdr3")).alias("neg"), "root", "n_reads"))
    one = lineages.groupBy(*by).agg(F.count("*").alias("n"), top.alias("t"), F.count_if(F.col("n_unique_cdr3") >= least).alias("u"), F.count_if(F.col("n_reads") >= least).alias("r"))
    values = [F.col("n"), F.coalesce(-F.col("t.neg"), F.lit(0)), F.coalesce("t.n_reads", F.lit(0)), F.col("u"), F.col("r")]
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), v.cast("long").alias("value")) for k, (m, v) in enumerate(zip(metric_names(least), values, strict=True))]
    return one.select(*by, F.inline(F.array(*rows)))


def weblogo(reads: DataFrame, member: DataFrame) -> DataFrame:
    """ord, aa: amino acids of the largest lineage's reads, spaces as ``*``, padded with ``*`` to the longest."""
    scratch = Scratch(reads.sparkSession, "weblogo")
    top = largest(summaries(member)).select("component")
    wanted = member.join(F.broadcast(top), "component", "left_semi").select("cdr3")  # one row
    at, n = scratch.write_counted(wanted, "wanted")
    rows = semi_join(reads, scratch.read(at, wanted), n).select("ord", F.translate("cdr3_aa", " ", "*").alias("aa"))
    rows = scratch.table(rows, "rows")  # read twice, and reads may be dear
    width = rows.agg(F.max(F.length("aa")).alias("w"))
    return rows.crossJoin(F.broadcast(width)).select("ord", F.expr("rpad(aa, w, '*')").alias("aa"))  # one row again
