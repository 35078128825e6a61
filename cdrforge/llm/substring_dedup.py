"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window.

Documents are dealt into batches by ranges of their id, so that an earlier batch
holds smaller ids only. A batch sends each of its distinct window hashes once, in
one packed row per hash bucket; the bucket counts in how many batches a hash
occurs and answers one bit for each: it also occurs in an earlier batch. With
these bits and its own documents a batch knows all windows that start in a
smaller id. Repeated windows merge into maximal intervals of removed words.

A passage that a third of all documents share is one hash per batch, so no
bucket grows with it. A hash is 64 bits wide and its bucket comes from a second,
independent polynomial, so two windows are confused with a chance of about
1 / (2**64 * buckets). Batches and buckets are sized in bytes: work in a task is
bounded by ``batch_bytes`` (of text, or one longer text) and ``bucket_bytes`` (of
hashes). Rows of one id, or without an id, that exceed a batch are dealt over several
by their text; these share a range, and so none of them is earlier than another. Unless told otherwise both follow the input, so that what a batch sends to
a bucket stays half a kilobyte at least up to 128 TB.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.hashing import U, buffers, pieces, windows, words
from cdrforge.storage import Scratch
from cdrforge.workers import give_back

_LAST = (1 << 63) - 1  # a null id comes after all others
_PARTS, _BUCKETS, _SMALL = 128, 256, 1 << 18


_LEAST_BLOB, _MOST_BYTES, _WEIGHT = 512, 256 << 20, 1 << 14
#: Batches of one range at most; a batch's number is its range's times this, and its place in it.
_TWINS = 1 << 20


def sizes(total: int, batch_bytes: int | None, bucket_bytes: int | None) -> tuple[int, int]:
    """Bytes of a batch and of a bucket for ``total`` bytes of text, where they are not given: the square root of what keeps blobs long, within bounds."""
    even = min(_MOST_BYTES, int((_LEAST_BLOB * total) ** 0.5))
    return batch_bytes or max(16 << 20, even), bucket_bytes or max(8 << 20, even)


def range_ends(sized: DataFrame, parts: int) -> list[int]:
    """Ends of at most ``parts`` ranges of ids that hold about the same bytes: all but the last one's. ``sized``: id, bytes.

    An id counts once for each ``_WEIGHT`` bytes, in a range exchange, which samples a bounded number of rows.
    """
    if parts < 2:
        return []
    rows = sized.select("id", F.explode(F.expr(f"sequence(0L, bytes div {_WEIGHT})")).alias("k")).select("id").repartitionByRange(parts, "id")
    return sorted(r["e"] for r in rows.groupBy(F.spark_partition_id()).agg(F.max("id").alias("e")).collect())[:-1]


def heavy_ids(sized: DataFrame, batch_bytes: int) -> dict[int, int]:
    """Ids of several rows that hold more than a batch together, and over how many batches they are dealt: fewer than there are batches."""
    rows = sized.groupBy("id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > batch_bytes) & (F.col("n") > 1)).collect()
    return {r["id"]: min(-(-r["bytes"] // batch_bytes), _TWINS) for r in rows}


def range_number(df: DataFrame, column: str, ends: list[int], name: str = "batch") -> DataFrame:
    """``df`` with how many of the sorted ``ends`` lie below the column: by a few literals, and then a table of eight bytes for each end."""
    step = max(1, int(len(ends) ** 0.5))
    rows = [ends[i : i + step] for i in range(0, len(ends), step)]
    if not rows:
        return df.withColumn(name, F.lit(0))
    tops = F.array(*(F.lit(r[-1]).cast("long") for r in rows))
    table = df.sparkSession.createDataFrame(list(enumerate(rows)), "__k int, __ends array<long>")
    out = df.withColumn("__top", F.size(F.filter(tops, lambda t: t < F.col(column))))
    below = F.coalesce(F.expr(f"size(filter(__ends, t -> t < {column}))"), F.lit(0))
    return out.join(F.broadcast(table), F.col("__top") == F.col("__k"), "left").withColumn(name, F.least(F.col("__top") * step + below, F.lit(len(ends))).cast("int")).drop("__top", "__k", "__ends")


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))


def _hashes(table: pa.Table, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's windows: hash, bucket, index of the first word; and the number of words before each document."""
    out, begin, done = [], [0], 0
    for part in (p for b in table.to_batches() for p in pieces(b, "text")):
        w = words(part.column("text"))
        g = windows(w.hash, size)
        inside = np.ones(len(g), bool)
        for cut in w.first[1:-1]:
            inside[max(0, cut - size + 1) : cut] = False
        other = windows(w.hash, size, 0xA24BAED4963EE407)
        at = np.flatnonzero(inside)
        out.append((g[at], (other[at] % U(buckets)).astype(np.uint32), at + done))
        begin += list(w.first[1:] + done)
        done += len(w.hash)
    h, b, at = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return h, b, at, np.array(begin)


def _distinct(h: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket and hash, and where in it a new pair begins."""
    order = np.lexsort((h, b))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, new


def _send(size: int, buckets: int):
    kind = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        give_back()  # of the group before
        batch = table.column("batch")[0].as_py()
        h, b, _, _ = _hashes(_ordered(table), size, buckets)
        order, new = _distinct(h, b)
        h, b = h[order[new]], b[order[new]]
        cut = np.flatnonzero(np.diff(b, prepend=np.uint32(1 << 31))) if len(b) else np.zeros(0, int)
        blobs = [h[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(h)], strict=True)] if len(cut) else []
        return pa.table([pa.array(b[cut].astype(np.int32)), pa.array([batch] * len(cut), pa.int64()), pa.array(blobs, pa.binary())], schema=kind)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bit for each hash of each batch: a batch of an earlier range has it as well."""
    table = table.sort_by("batch")
    blobs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(blobs)
    span = np.repeat(table.column("batch").to_numpy() // _TWINS, [len(x) for x in blobs])
    order = np.argsort(h, kind="stable")
    lead = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else order
    again = np.zeros(len(h), bool)
    again[order] = span[order] > np.repeat(span[order[lead]], np.diff(lead, append=len(h)))
    cut = np.cumsum([0, *map(len, blobs)])
    bits = [again[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    use = [i for i, x in enumerate(bits) if x.any()]
    return pa.table([table.column("batch").take(pa.array(use, pa.int64())), table.column("bucket").take(pa.array(use, pa.int64())), pa.array([np.packbits(bits[i]).tobytes() for i in use], pa.binary())], names=["batch", "bucket", "bits"])


def _remove(size: int, buckets: int, carried: list[str], layout: bool):

    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        give_back()  # of the group before
        table = _ordered(table)
        h, b, at, begin = _hashes(table, size, buckets)
        order, new = _distinct(h, b)
        which = np.cumsum(new) - 1  # of the ordered windows
        far = np.zeros(int(new.sum()), bool)
        lead = np.flatnonzero(new)
        low = np.searchsorted(b[order[lead]], flags.column("bucket").to_numpy().astype(np.uint32))
        for x, bits in zip(low, flags.column("bits").to_pylist(), strict=True):
            got = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(far) - x].astype(bool)
            far[x : x + len(got)] |= got
        ids = table.column("id").to_numpy()
        owner = ids[np.searchsorted(begin, at, "right") - 1]
        least = np.minimum.reduceat(owner[order], lead) if len(lead) else owner
        gone = far[which] | (least[which] < owner[order])
        step = np.zeros(int(begin[-1]) + size + 1, np.int32)
        np.add.at(step, at[order[gone]], 1)
        np.add.at(step, at[order[gone]] + size, -1)
        keep = np.cumsum(step)[: int(begin[-1])] == 0
        n_words, n_removed, kept = [], [], []
        data, offsets = buffers(table.column("text"))
        raw = data.tobytes()
        for i in range(table.num_rows):
            ws = raw[offsets[i] : offsets[i + 1]].split()
            k = keep[begin[i] : begin[i + 1]]
            lost = len(k) - int(k.sum())
            n_words.append(len(ws))
            n_removed.append(lost)
            kept.append(raw[offsets[i] : offsets[i + 1]] if layout and not lost else b" ".join(compress(ws, k) if lost else ws))
        new = [pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*new, *(table.column(c) for c in carried)], names=["id", "n_words", "n_removed", "kept", *carried])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, carry: list[str] | None = None, layout: bool = False, batch_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (text), and the columns named in ``carry``.

    A word goes if a window of ``window`` words over it, words being
    ``[^\\x20\\x09-\\x0D]+`` unchanged, also starts in a document with a smaller
    id. Windows are judged on the input. The words left are joined by one space;
    with ``layout`` a text that loses none stays as it is. A null text has no
    words; a text of fewer words than a window loses none. A null id comes after
    all others. Rows of one id do not remove each other's words. Equal rows of one id
    stand in one batch, however many they are. Columns that are
    not carried are ignored, whatever their names; a carried column must not have
    the name of a returned one. An empty table gives an empty one.
    """
    named = {c: f"c{k}" for k, c in enumerate(carry or [])}
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    sized = Scratch(docs.sparkSession, "substrings").table(base.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")), "sizes")
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    batch_bytes, bucket_bytes = sizes(total, batch_bytes, bucket_bytes)
    parts = max(min(_PARTS, total // _SMALL), total // batch_bytes, 1)
    buckets = int(max(min(_BUCKETS, total // 4096), total * 8 // 5 // bucket_bytes, 1))
    heavy = heavy_ids(sized, total // parts) if parts > 1 else {}
    twins = F.broadcast(docs.sparkSession.createDataFrame(list(heavy.items()), "__id long, __twins long"))  # fewer rows than batches
    ends = sorted({*range_ends(sized.join(twins, F.col("id") == F.col("__id"), "left_anti"), parts), *(e for h in heavy for e in (h - 1, h))} - {_LAST})
    dealt = range_number(base, "id", ends, "range").join(twins, F.col("id") == F.col("__id"), "left")
    twin = F.coalesce(F.expr("pmod(xxhash64(text, 3), __twins)"), F.lit(0))
    dealt = dealt.withColumn("batch", F.col("range") * F.lit(_TWINS).cast("long") + twin).drop("range", "__id", "__twins")
    sent = dealt.groupBy("batch").applyInArrow(_send(window, buckets), "bucket int, batch long, hashes binary")
    flags = sent.groupBy("bucket").applyInArrow(_answer, "batch long, bucket int, bits binary")
    extra = "".join(f", {n} {dealt.schema[n].dataType.simpleString()}" for n in named.values())
    out = dealt.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(_remove(window, buckets, list(named.values()), layout), "id long, n_words long, n_removed long, kept string" + extra)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col(n).alias(c) for c, n in named.items()))
