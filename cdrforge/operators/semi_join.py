"""Rows whose key is among others, where rows are many and the keys wanted are few in comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys up to which Spark's own broadcast is left to do it, and bits of a filter at most: 8 MB.
_FEW, _MOST_BITS, _PROBES = 50_000, 1 << 26, 3


def _probes(key: Column, bits: int) -> list[Column]:
    """Independent hashes: each begins with a value of its own."""
    return [F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) for k in range(_PROBES)]


def bit_filter(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with an array of longs, the Bloom filter of the one column of ``keys``; and its bits."""
    bits = max(1 << 12, min(_MOST_BITS, 1 << (16 * n).bit_length()))
    at = keys.select(F.explode(F.array(*_probes(F.col(keys.columns[0]), bits))).alias("p"))
    words = at.groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    dense = keys.sparkSession.range(bits >> 6).join(words, F.col("id") == F.col("word"), "left")
    return dense.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("w")).select(F.col("w.b").alias("__bits")), bits


def possible(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``, told where they are read."""
    table, bits = bit_filter(keys, n)
    out = rows.crossJoin(F.broadcast(table))  # one row of 8 MB at most
    for p in _probes(F.col(keys.columns[0]), bits):
        out = out.where(F.get("__bits", F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return out.drop("__bits")


def semi_join(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` whose key is in ``keys``: one column, written or cheap, of ``n`` distinct values, named like that of ``rows``.

    A few keys are broadcast by Spark. Of more, rows first pass a filter of bounded size,
    so that the join shuffles little but what it keeps; where even that would be full,
    all rows are joined. The result is the same.
    """
    if _FEW < n <= _MOST_BITS // 16:
        rows = possible(rows, keys, n)
    return rows.join(keys, keys.columns[0], "left_semi")
