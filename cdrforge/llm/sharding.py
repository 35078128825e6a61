"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text form a group. A group goes where the dot product of its
(bytes, tokens, rows) with a shard's residual capacity is highest. Groups of at
least 1/512 of a total are placed first, by the driver (there are at most 1536);
the rest is packed inside each partition into bins. Bins of ever fewer partitions
are packed into new ones until at most 4096 are left, and those are placed like
groups. A group of more than half a shard is dealt out by its rows' ids, since it
would break the balance by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.packing import encode
from cdrforge.storage import Scratch

_LARGE, _BINS, _FAN = 512, 4096, 64
_SIZES = ("bytes", "tokens", "rows")


def place(items: np.ndarray, loads: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The bin of each item (rows of sizes, largest first is best); ``loads`` is brought up to date.

    The highest dot product with what is left of ``capacity`` wins, ties go to the lowest bin.
    """
    out = np.zeros(len(items), np.int64)
    for i, item in enumerate(items):
        out[i] = k = int(np.argmax((capacity - loads) @ item))
        loads[k] += item
    return out


def _largest_first(share: np.ndarray, loads: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    order = np.argsort(-share.max(1), kind="stable")
    out = np.zeros(len(share), np.int64)
    out[order] = place(share[order], loads, capacity)
    return out


def _shares(batch: pa.RecordBatch | pa.Table, total: list[float]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in _SIZES], 1) / np.array(total)


def _counted(tokenizer: str):
    kind = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("h", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(x.as_py(), tokenizer)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "size", "crc", "h")), pa.array(n, pa.int64())], schema=kind)

    return run


def _local(total: list[float], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, part, seen = np.zeros((n, 3)), TaskContext.get().partitionId(), np.zeros(3)
        for batch in batches:
            share = _shares(batch, total)
            seen += share.sum(0)
            bins = _largest_first(share, loads, seen / n)
            columns = {c: batch.column(c) for c in ("h", "crc", "size", "salt")} | {"part": pa.array([part] * len(share), pa.int64()), "bin": pa.array(bins)} | {c: batch.column(c) for c in _SIZES}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _merge(total: list[float], n: int):
    """Bins of some partitions into ``n`` new ones."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("bin", "ascending")])
        share = _shares(table, total)
        return table.append_column("to", pa.array(_largest_first(share, np.zeros((n, 3)), share.sum(0) / n)))

    return run


def shard(docs: DataFrame, tokenizer: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes (UTF-8 bytes of the text and 1) are near equal over the shards: law
    ``bytes``; tokens (of the byte-level BPE file ``tokenizer``) and row counts are
    weighed alike and come as near. A null text has no bytes and is grouped with
    empty ones. Null and repeated ids are placed
    like others. Other columns are ignored, whatever their names; an empty table
    gives an empty one. ``slot`` numbers a shard's rows from 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = rows.mapInArrow(_counted(tokenizer), "id long, size long, crc long, h long, tokens long")
    rows = scratch.table(rows, "rows").withColumn("salt", F.lit(0).cast("long"))
    key = ["h", "crc", "size", "salt"]

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))

    groups = scratch.table(grouped(rows), "groups")
    total = [float(x or 1) for x in groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()]
    share = F.greatest(F.col("bytes") / total[0], F.col("tokens") / total[1], F.col("rows") / total[2])
    # at most 6 * shards groups; their rows are dealt out
    if whole := groups.where(share > 1 / (2 * shards)).select("h", "crc", "size", F.ceil(share * 8 * shards).cast("long").alias("of")).collect():
        known = F.broadcast(spark.createDataFrame(whole, "h long, crc long, size long, of long"))
        rows = rows.join(known, ["h", "crc", "size"], "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(id), of)"), F.lit(0)).cast("long")).drop("of")
        groups = scratch.table(grouped(rows), "groups")
    loads, capacity = np.zeros((shards, 3)), np.full(3, 1 / shards)
    first = groups.where(share >= 1 / _LARGE).orderBy(*key).collect()
    vectors = np.array([[g["bytes"], g["tokens"], g["rows"]] for g in first], float).reshape(-1, 3) / total
    where = _largest_first(vectors, loads, capacity)
    placed = spark.createDataFrame([(g["h"], g["crc"], g["size"], g["salt"], int(s)) for g, s in zip(first, where, strict=True)], "h long, crc long, size long, salt long, shard int")
    small = groups.where(share < 1 / _LARGE)
    parts = small.rdd.getNumPartitions()
    n = max(shards, _BINS // max(1, parts))
    kind = ", ".join(f"{c} long" for c in ("part", "bin", *_SIZES))
    local = scratch.table(small.mapInArrow(_local(total, n), f"h long, crc long, size long, salt long, {kind}"), "bins")
    summed = lambda df, part, bin_: df.groupBy(F.col(part).alias("part"), F.col(bin_).alias("bin")).agg(*(F.sum(c).alias(c) for c in _SIZES))
    level, steps = summed(local, "part", "bin"), []
    while parts > 1 and parts * n > _BINS:
        parts = -(-parts // _FAN)
        merged = level.withColumn("up", F.expr(f"part div {_FAN}")).groupBy("up").applyInArrow(_merge(total, n), f"{kind}, up long, to long")
        steps.append(scratch.table(merged, "merged"))
        level = summed(steps[-1], "up", "to")
    bins = level.orderBy("part", "bin").collect()  # _BINS of them at most, or one for each shard
    vectors = np.array([[b[c] for c in _SIZES] for b in bins], float).reshape(-1, 3) / total
    where = _largest_first(vectors, loads, capacity)
    named = spark.createDataFrame([(b["part"], b["bin"], int(s)) for b, s in zip(bins, where, strict=True)], "part long, bin long, shard int")
    for step in reversed(steps):
        named = step.select("part", "bin", "up", "to").join(named.toDF("up", "to", "shard"), ["up", "to"]).select("part", "bin", "shard")
    placed = placed.unionByName(local.join(named, ["part", "bin"]).select(*key, "shard"))
    # files whose rows stand by shard: a row's number is its place less where its shard begins, and the rows of files before
    dealt = scratch.table(rows.join(placed, key).select("id", "size", "crc", "shard").sortWithinPartitions("shard"), "placed").withColumns({"file": F.col("_metadata.file_path"), "at": F.col("_metadata.row_index")})
    counts = dealt.groupBy("file", "shard").agg(F.count("*").alias("n"), F.min("at").alias("start"))
    # as many rows a shard as there are files
    shift = counts.withColumn("shift", F.expr("sum(n) over (partition by shard order by file rows between unbounded preceding and current row) - n - start")).drop("n", "start")
    out = dealt.join(shift, ["file", "shard"]).withColumn("slot", F.col("shift") + F.col("at"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
