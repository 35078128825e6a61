"""Components of the similarity graph without a list of its edges.

A dense family has edges by the square of its size, and its components need few of
them. So nodes are linked first where no comparison is needed: those that are alike
outside a window of as many places as may differ. Of what is then still apart, each
pair that has a join key in common is compared, as in the join of all edges; but in a
key all rows of the component that most of its rows belong to are on one side only.
Pairs of one component are left out, no others, so the components are those of all
edges; what is compared goes by the rows that stand outside. Keys of like sequences are
compared in tiles, as there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cdrforge.functions.sequences import max_distance
from cdrforge.operators import similarity, tiles
from cdrforge.operators.components import connected_components
from cdrforge.storage import Scratch

#: Edges that one task may finish, as many as it holds at once anyway, and that a task contracts.
_ONE_TASK, _TASK = 1_000_000, 500_000


def near_links(nodes: DataFrame, ratio: float, by: Sequence[str] = ()) -> DataFrame:
    """(a, b) of ids: each node and the next one that is alike outside some window; windows overlap by half.

    Two differ inside the window only, so in no more places than may differ. Groups are
    told apart by 128 bits of hashes.
    """
    limit = F.floor(max_distance(F.col("cdr_length"), ratio)).cast("int")
    base = nodes.select("id", *by, "cdr_length", F.col("cdr3").cast("binary").alias("raw"), F.octet_length("cdr3").alias("bytes"), limit.alias("d"), F.explode("v_call").alias("v"), "j_call").where("d > 0")
    base = base.select("*", F.explode("j_call").alias("j")).drop("j_call")
    at = base.select("*", F.explode(F.expr("sequence(1, greatest(1, bytes - d + 1), (d + 1) div 2)")).alias("at"))
    parts = (*by, "cdr_length", "bytes", "v", "j", "at", F.substring("raw", F.lit(1), F.col("at") - 1), F.substring("raw", F.col("at") + F.col("d"), F.col("bytes")))
    # the second hash begins with another value: a hash of (parts, 1) would only be one of the first hash
    keys = at.where("v is not null and j is not null").select("id", F.xxhash64(*parts).alias("k"), F.xxhash64(F.lit(1), *parts).alias("k2"))
    before = F.lag("id").over(Window.partitionBy("k", "k2").orderBy("id"))
    return keys.select(before.alias("a"), F.col("id").alias("b")).where("a is not null")


def _compared(left: DataFrame, right: DataFrame, ratio: float, x: similarity.Layout, by: Sequence[str]) -> DataFrame:
    """(a, b) of components: those of pairs with equal ``k`` that are edges."""
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in "ab")
    pairs = left.alias("a").hint("merge").join(right.alias("b"), a("k") == b("k"))
    unequal = [a(c).bitwiseXOR(b(c)) for c in ("v", "j", "cdr_length")]
    rules = [
        a("comp") != b("comp"), functools.reduce(lambda p, q: p.bitwiseOR(q), unequal) == 0,
        similarity.unlike(a, b, x) <= max_distance(a("cdr_length"), ratio), *(a(c).eqNullSafe(b(c)) for c in by),
    ]
    return pairs.where(functools.reduce(lambda p, q: p & q, rules)).select(a("comp").alias("a"), b("comp").alias("b"))


def _tile_links(rows: DataFrame, block: int, x: similarity.Layout, by: Sequence[str]) -> DataFrame:
    """The same as by ``_compared``, of keys with ``c`` rows of which ``outside`` ones are to be compared with all."""
    longs, same = [f"w{i}" for i in range(x.size)], ["v", "j", "cdr_length"]
    parts = [F.greatest(F.lit(1), F.ceil(F.col(c) / (similarity._TILE * block))) for c in ("outside", "c")]
    rows = rows.select("k", "key", "comp", "main", *by, *same, *longs, (F.col("n") - 1).alias("most"), *(p.alias(c) for p, c in zip(parts, ("nx", "ny"), strict=True)))

    def dealt(some: DataFrame, side: int, own: str, other: str) -> DataFrame:
        return some.withColumn("side", F.lit(side)).withColumn(own, F.expr(f"pmod(xxhash64(key, 7), n{own})")).withColumn(other, F.explode(F.expr(f"sequence(0L, n{other} - 1)"))).drop("key", "main", "nx", "ny")

    def met(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
        comp, alike = table.column("comp").to_numpy(), [*(table.column(c).to_numpy() for c in same), *(tiles.codes(table.column(c)) for c in by)]

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            good = comp[a] != comp[b]
            for c in alike:
                good &= c[a] == c[b]
            links = np.unique(np.stack([comp[a[good]], comp[b[good]]]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links], names=["a", "b"])

        return pairs

    outside = rows.where("comp <> main")
    kind = rows.select(F.col("comp").alias("a"), F.col("comp").alias("b")).schema
    return tiles.compare(dealt(outside, 0, "x", "y").unionByName(dealt(rows, 1, "y", "x")), longs, "most", met, kind, x.packed)


def _class_links(nodes: DataFrame, ratio: float, block: int, x: similarity.Layout, by: Sequence[str], scratch: Scratch) -> list[DataFrame]:
    """Links between components, of one class of lengths."""
    rows, out = similarity._keyed(nodes, ratio, "id", x, by, None, "comp"), []
    for level in range(1, similarity.LEVELS + 1):
        rows = rows.drop("fresh", *(c for c in rows.columns if c.startswith(("h1_", f"h{level}_", "before")) or c in ("vs", "js")))
        each = rows.groupBy("k", "comp").agg(F.count("*").alias("c"), F.count_if(F.col("bytes") != F.col("cdr_length")).alias("odd"))
        keys = each.groupBy("k").agg(F.max_by("comp", "c").alias("main"), F.sum("c").alias("c"), (F.sum("c") - F.max("c")).alias("outside"), F.sum("odd").alias("odd")).where("outside > 0")
        # hot: more to compare than a key of ``block`` rows would have. Strings that have not the reported length do not line up with others outside a chunk
        cells = F.ceil(F.col("outside").cast("double") * F.col("c") / (float(block) * block)).cast("int")
        even = (F.col("odd") == 0) & F.lit(level < similarity.LEVELS)
        near = (F.col("odd") == 0) & F.lit(not x.wide) & (F.col("outside").cast("double") * F.col("c") > (float(block) / (2 * similarity._FEW)) ** 2)
        keys = keys.select("k", "main", "c", "outside", cells.alias("nb"), (even & (cells > 1)).alias("deep"), near.alias("near"))
        rows = rows.join(keys, "k")
        at, n = scratch.write_counted(rows.withColumn("rest", F.when(F.col("deep") | F.col("near"), F.col("rest"))), f"apart{level}")
        rows = scratch.read(at, rows)
        if not n:
            break
        some = rows.where("near")
        if not some.isEmpty():
            chosen = similarity.alike_keys(some, level, x) if level < similarity.LEVELS else some.select("k").distinct()
            chosen = scratch.table(chosen, f"alike{level}")
            out.append(_tile_links(some.join(chosen, "k", "left_semi"), block, x, by))
            rows = rows.join(chosen, "k", "left_anti")
        rows = rows.drop("near", "c", "outside")
        flat = rows.where("not deep").drop("rest")
        left = flat.where("comp <> main").withColumn("of", F.explode(F.expr("sequence(0, nb - 1)")))
        right = flat.withColumn("of", F.expr("cast(pmod(xxhash64(key, 7), nb) as int)"))
        out.append(_compared(*(side.withColumn("k", F.xxhash64("k", "of")) for side in (left, right)), ratio, x, by))
        if level == similarity.LEVELS or rows.where("deep").isEmpty():
            break
        rows = similarity._cut_again(rows.where("deep").drop("main", "nb", "deep"), level + 1, x)
    return out


def clusters(nodes: DataFrame, ratio: float = 0.1, by: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """nodes with ``component``, the smallest id of its component in the graph of ``similarity.edges``; ``id`` is a unique long.

    ``block``: a key with more to compare than one of so many rows is cut again or dealt out.
    """
    scratch = Scratch(nodes.sparkSession, "clusters")
    label = connected_components(near_links(nodes, ratio, by), "near", one_task_rows=_ONE_TASK, task_rows=_TASK)
    first = nodes.join(label.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    first = scratch.table(first.select(*nodes.columns, "comp"), "first")
    links = [e for x in similarity.layouts(nodes, ratio) for e in _class_links(first, ratio, block, x, by, scratch)]
    if not links:
        return first.withColumnRenamed("comp", "component")
    last = connected_components(functools.reduce(DataFrame.unionByName, links), "lineages", one_task_rows=_ONE_TASK, task_rows=_TASK)
    return first.join(last, first["comp"] == last["node"], "left").select(*nodes.columns, F.coalesce("component", "comp").alias("component"))
