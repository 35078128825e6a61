"""Near-duplicate vectors: a navigable small-world graph for each shard, queried by every vector.

Equal vectors form a class, and one of it is indexed. Each shard's graph is built
once; a task loads it and the queries stream by in blocks. A sample of each block
is compared with all vectors of the shard, and beams are widened until the sample's
links are found. Where few of the sample have links, neighbours are planted: vectors
just within the cosine of some of the shard's, whose links are looked for as well. A beam that is full of links is widened for its query alone. Where
a beam would have to look at more vectors one by one than a matrix product with the
whole shard is worth, as in a dense group, that product is taken instead, slice by
slice. Links are confirmed in double precision, counted and joined up as they come:
a task keeps one slice of them and sends counts and a forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.classes import join_classes
from cdrforge.llm.hnsw import Index
from cdrforge.operators.components import connected_components
from cdrforge.storage import Scratch

#: A beam of w looks at some 2 M w vectors; from n / _SCAN on, a product with all n of them is cheaper.
_SCAN = 256
#: Cells of a product at once.
_CELLS = 1 << 22
#: Bytes of a block of queries.
_HELD = 64 << 20
#: An audit takes more queries until so many have links, and so many times its size at most.
_LINKED, _MORE = 32, 8


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    x = _unit(_vectors(table.column("v")))
    index = Index.build(x.astype(np.float32))
    return pa.table({"shard": table.column("shard")[:1], "dim": table.column("dim")[:1], "graph": [index.dump()], "ids": [table.column("id").to_numpy().tobytes()], "weights": [table.column("w").to_numpy().tobytes()], "exact": [x.tobytes()]})


def links(index: Index, exact: np.ndarray, q: np.ndarray, cosine: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of the links found, in slices that are sorted by query; a query's links stand in one slice.

    ``width`` of ``len(exact)`` or more: by products with all vectors.
    """
    n, error = len(exact), (exact.shape[1] + 16) * 2.0**-22  # of a dot product in single precision
    q32 = q.astype(np.float32)

    def confirmed(row: np.ndarray, node: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = sim >= cosine + error
        close = np.flatnonzero(~ok)
        for k in range(0, len(close), 65536):
            part = close[k : k + 65536]
            ok[part] = np.einsum("ij,ij->i", q[row[part]], exact[node[part]]) >= cosine
        return row[ok], node[ok]

    todo = np.arange(len(q))
    first = True
    while len(todo) and width < n and (first or width * _SCAN < n):
        first, full = False, []
        for k in range(0, len(todo), 512):
            part = todo[k : k + 512]
            node, sim = index.query(q32[part], width)
            near = sim >= cosine - error
            more = near.all(1)  # nothing but links: there may be others
            full.append(part[more])
            r, c = np.nonzero(near & ~more[:, None])
            yield confirmed(part[r], node[r, c], sim[r, c])
        todo, width = np.concatenate(full), width * 4
    for k in range(0, len(todo), step := max(1, _CELLS // n)):
        part = todo[k : k + step]
        sim = q32[part] @ index.x.T
        r, c = np.nonzero(sim >= cosine - error)
        yield confirmed(part[r], c, sim[r, c])


def _truth(exact: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float, audit: int) -> dict[int, np.ndarray]:
    """Links of audited queries, of those that have any to others than themselves."""
    order = np.random.default_rng(1).permutation(len(q))[: audit * _MORE]
    out: dict[int, np.ndarray] = {}
    for k in range(0, len(order), max(1, audit)):
        for r in order[k : k + audit]:
            true = np.flatnonzero(exact @ q[r] >= cosine)
            true = true[true != own[r]]
            if len(true):
                out[int(r)] = true
        if len(out) >= _LINKED:
            break
    return out


def planted(exact: np.ndarray, cosine: float, n: int) -> np.ndarray:
    """``n`` unit vectors, each a little closer to one of the shard's than ``cosine``, in a random direction from it."""
    rng = np.random.default_rng(3)
    near = exact[rng.integers(0, len(exact), n)]
    away = rng.standard_normal(near.shape)
    away -= np.einsum("ij,ij->i", away, near)[:, None] * near
    size = np.sqrt((away * away).sum(1, keepdims=True))
    close = cosine + (1 - cosine) * 0.05
    # in one dimension there is no direction away
    return _unit(close * near + np.sqrt(1 - close * close) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9))


def audited(index: Index, exact: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float, width: int, audit: int, recall: float) -> tuple[int, int, float]:
    """The width at which the audited queries find ``recall`` of their links on average; how many they are, and their recall.

    ``own``: a query's own node, or -1. With less than ``_LINKED`` queries that have links, planted ones make up for the rest.
    """
    truth, n = _truth(exact, q, own, cosine, audit), len(exact)
    if len(truth) < _LINKED:
        more = planted(exact, cosine, _LINKED - len(truth))
        truth |= {len(q) + k: np.flatnonzero(exact @ v >= cosine) for k, v in enumerate(more)}
        q = np.concatenate([q, more])
    rows = np.array(list(truth))
    while True:
        got: list = [np.zeros(0, np.int64)] * len(rows)
        for r, node in links(index, exact, q[rows], cosine, width):
            cut = np.flatnonzero(np.diff(r, prepend=-1))
            for k, part in zip(r[cut], np.split(node, cut[1:]), strict=False):
                got[k] = part
        found = float(np.mean([np.isin(true, g).mean() for true, g in zip(truth.values(), got, strict=True)]))
        if found >= recall or width >= n:
            return width, len(truth), found
        width = width * 2 if width * 2 * _SCAN < n else n


class Forest:
    """Joins nodes that a query links; says which ties that takes."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, node: np.ndarray) -> np.ndarray:
        r = self.up[node]
        while True:
            to = self.up[r]
            if (to == r).all():
                break
            r = to
        self.up[node] = r
        return r

    def join(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs sorted by row: each row with one of its nodes, and ties between nodes."""
        lead = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(lead):
            return row, node, row, node
        r = self.roots(node)
        a, b = [], []
        stop = np.append(lead[1:], len(row))
        for k in np.flatnonzero(np.minimum.reduceat(r, lead) != np.maximum.reduceat(r, lead)):
            u = np.unique(self.roots(node[lead[k] : stop[k]]))
            self.up[u[1:]] = u[0]
            a.append(np.full(len(u) - 1, u[0]))
            b.append(u[1:])
        none = np.zeros(0, np.int64)
        return row[lead], node[lead], np.concatenate([none, *a]), np.concatenate([none, *b])


_FOUND = "a long, b long, n long, dim int, shard long, audited long, recall double, width long"
_KIND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("shard", pa.int64()), ("audited", pa.int64()), ("recall", pa.float64()), ("width", pa.int64())])


class _Shard:
    """One shard's graph in a task, and what its queries find."""

    def __init__(self, row: dict) -> None:
        self.ids, self.weights = (np.frombuffer(row[c], np.int64) for c in ("ids", "weights"))
        self.exact = np.frombuffer(row["exact"]).reshape(len(self.ids), -1)
        self.index = Index.load(row["graph"], self.exact.astype(np.float32))
        self.forest, self.key = Forest(len(self.ids)), (row["dim"], row["shard"])

    def search(self, own: np.ndarray, q: np.ndarray, cosine: float, width: int, audit: int, recall: float) -> Iterator[pa.RecordBatch]:
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)  # ids are sorted
        at = np.where(self.ids[at] == own, at, -1)
        width, many, found = audited(self.index, self.exact, q, at, cosine, width, audit, recall)
        yield self._batch(1, audited=[many], recall=[found], width=[width], dim=[self.key[0]], shard=[self.key[1]])
        counts = np.zeros(len(own), np.int64)
        for row, node in links(self.index, self.exact, q, cosine, width):
            apart = at[row] != node
            row, node = row[apart], node[apart]
            counts += np.bincount(row, self.weights[node], len(own)).astype(np.int64)
            r, k, x, y = self.forest.join(row, node)
            yield self._batch(len(r) + len(x), a=np.concatenate([own[r], self.ids[x]]), b=np.concatenate([self.ids[k], self.ids[y]]))
        some = np.flatnonzero(counts)
        yield self._batch(len(some), a=own[some], n=counts[some])

    @staticmethod
    def _batch(size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _KIND], schema=_KIND)


def _query(cosine: float, width: int, audit: int, recall: float, block: int):
    """For rows sorted by dim, shard and kind (a graph before its queries): links, ties and audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                own, q = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                held.clear()
                yield from shard.search(own, _unit(q), cosine, width, audit, recall)

        for batch in batches:
            dim, of = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            graph = batch.column("kind").to_numpy() == 0
            new = graph.copy()
            new[1:] |= (dim[1:] != dim[:-1]) | (of[1:] != of[:-1])
            cut = [0, *(k for k in np.flatnonzero(new) if k), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if graph[a]:
                    yield from flush()
                    shard = _Shard(batch.slice(a, 1).to_pylist()[0])
                    a += 1
                if a == b or shard is None or shard.key != (dim[a], of[a]):  # vectors of a length that this shard has none of
                    continue
                held.append((batch.column("id").slice(a, b - a).to_numpy(), _vectors(batch.column("v").slice(a, b - a))))
                if sum(len(h[0]) for h in held) >= block or sum(h[1].nbytes for h in held) >= _HELD:
                    yield from flush()
        yield from flush()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, shards: int = 6, shard_rows: int = 100_000, shard_bytes: int = 128 << 20, block: int = 16_384, width: int = 32, audit: int = 128, recall: float = 0.99, report: str | None = None) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    ``n_links`` counts other vectors with a cosine of at least ``cosine``, copies
    each for itself; ``component_id`` is the smallest id that links reach. A
    vector that is null, empty, zero or has a null or non-finite component has no
    links, nor has one of another length. A null id has a null component, is kept,
    and is not counted; rows of one id are vectors of their own but share a
    component. Other columns are ignored, whatever their names; an empty table
    gives an empty one. A shard holds ``shard_rows`` vectors and ``shard_bytes`` of
    doubles at most on average. With ``report``, a Parquet table of the audits goes
    there: dim, shard, audited (queries with links, planted ones among them), recall
    (their mean) and width, a row for each block of queries and shard.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.expr("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c <> 0)")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).withColumn("ok", F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull())
    # -0.0 and 0.0 are equal components; scales that overflow a double's square are brought down
    rows = rows.withColumn("v", F.expr("case when ok then transform(v, c -> c / array_max(transform(v, d -> abs(d))) + 0.0D) end"))
    # the second hash begins with another value: a hash of (v, 1) would only be one of the first hash
    rows = rows.withColumns({"ka": F.when(F.col("ok"), F.xxhash64("v")), "kb": F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))})
    rows = scratch.table(rows, "rows")
    classes = scratch.table(rows.where("ok").groupBy("ka", "kb").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "sizes")
    known = classes.withColumnRenamed("rep", "id")
    reps = scratch.table(rows.where("ok").join(known, ["ka", "kb", "id"]).dropDuplicates(["ka", "kb"]).select("id", "w", "v", F.size("v").alias("dim")), "classes")
    n, cells = reps.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    of = max(shards, -(-n // shard_rows), -(-cells * 8 // shard_bytes))
    # a graph goes to as many tasks as keep the cores busy
    splits = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // of), -(-n // block)))
    dealt = reps.withColumn("shard", F.expr(f"pmod(xxhash64(id, 5), {of})"))
    index = dealt.groupBy("dim", "shard").applyInArrow(_build, "shard long, dim int, graph binary, ids binary, weights binary, exact binary")
    index = scratch.table(index, "graphs")
    left = index.withColumns({"kind": F.lit(0), "split": F.explode(F.expr(f"sequence(0L, {splits} - 1L)"))})
    right = reps.drop("w").withColumns({"kind": F.lit(1), "split": F.expr(f"pmod(xxhash64(id, 9), {splits})"), "shard": F.explode(F.expr(f"sequence(0L, {of} - 1L)"))})
    tasks = left.unionByName(right, allowMissingColumns=True).withColumn("task", F.expr(f"cast(pmod(xxhash64(dim), {of * splits}) + shard * {splits} + split as int)"))
    tasks = tasks.repartitionById(of * splits, "task").drop("task", "split").sortWithinPartitions("dim", "shard", "kind")
    found = scratch.table(tasks.mapInArrow(_query(cosine, width, audit, recall, block), _FOUND), "links")
    if report:
        found.where("audited is not null").select("dim", "shard", "audited", "recall", "width").write.mode("overwrite").parquet(report)
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    label = connected_components(found.where("b is not null").select("a", "b"), "vectors")
    named = classes.join(counts, classes["rep"] == counts["a"], "left").join(label, F.col("rep") == F.col("node"), "left")
    named = named.select("ka", "kb", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = join_classes(rows.select("id", "ka", "kb"), scratch.table(named, "named"), F.col("id"))
    out = out.withColumn("component_id", F.coalesce("c", "id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"))
