"""Connected components by alternating large-star and small-star steps.

Both steps are a ``min`` per node and an equi-join, so a hub that holds a third
of all edges is pre-aggregated before its shuffle and its join partition can be
split by adaptive execution. Edges are first contracted inside each partition,
which leaves at most a forest per task, and again over ever fewer partitions of a
bounded number of edges, as long as that pays. (Kiveris et al., Connected Components in
MapReduce and Beyond, 2014.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cdrforge.storage import Scratch

_MOST_ROUNDS = 60
#: Edges that a task holds, and nodes whose stars it keeps when they are contracted.
_HELD, _KEPT = 1 << 20, 500_000


def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges from every node to the smallest node of its component, in arrays: roots are hooked to smaller ones until each edge lies within one."""
    ends = pa.chunked_array([b.column(k) for k in (0, 1) for b in batches]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    u, v = np.split(rank[ends.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = (z[apart] for z in (u, v, x, y))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    inner = np.flatnonzero(root != np.arange(len(root)))
    columns = [ends.dictionary.take(pa.array(order[k])) for k in (inner, root[inner])]
    return pa.RecordBatch.from_arrays(columns, schema=batches[0].schema)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars to each local root, the smallest member.

    What has been found goes out when it is too much to keep; memory stays bounded.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            held = [stars(held)]
            if held[0].num_rows > _KEPT:
                yield held.pop()
    if any(b.num_rows for b in held):
        yield stars(held)


def connected_components(edges: DataFrame, name: str = "components", one_task_rows: int = 50_000, task_rows: int = 100_000) -> DataFrame:
    """Components of an undirected graph.

    ``edges``: two columns of one orderable type (long or string); rows with a
    null end and loops add nothing, repeated rows count once. Returns
    ``(node, component)`` for every node that has an edge to another one, with
    the smallest node of the component. An empty table gives an empty table. If at
    most ``one_task_rows`` edges are left after the contractions (they are counted),
    one task finishes the work.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, name)
    u, v = edges.columns[:2]
    kind = edges.schema[0].dataType.simpleString()
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.mapInArrow(contract, f"a {kind}, b {kind}")
    at, left = scratch.write_counted(e, "edges")
    e = scratch.read(at, e)
    named = lambda x: x.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while left > one_task_rows:
        fewer = e.repartition(-(-left // task_rows)).mapInArrow(contract, f"a {kind}, b {kind}")
        (nxt, now), before = scratch.write_counted(fewer, "edges"), left
        e = scratch.read(nxt, fewer)
        scratch.drop(at)
        at, left = nxt, now
        if left > 0.8 * before:
            break
    if left <= one_task_rows:
        return named(e.coalesce(1).mapInArrow(contract, f"a {kind}, b {kind}") if left else e)
    mark = None
    for _ in range(_MOST_ROUNDS):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        nxt, n = scratch.write_counted(small, "star")
        e = scratch.read(nxt, small)
        scratch.drop(at)
        at = nxt
        now = n, e.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0] if n else 0
        if now == mark or not n:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {_MOST_ROUNDS} rounds")
    return named(e)
