"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps at most ``open_windows`` windows. A document's whole windows
leave at once; its rest goes best-fit, into the open window it fills most. If it
fits in none and no window may be opened, the fullest is filled with a cut of the
rest and emitted. What is open at the end of a partition (a bounded number of
windows) is merged the same way in ever fewer partitions. The very last rest is
dealt into windows at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cdrforge.storage import Scratch
from cdrforge.workers import tidy

#: Fixed value: the words that the byte-level vocabulary splits a text into.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def encoder(path: str, special: bool = True):
    """The ids of a byte-level BPE file of the tokenizers library, by tiktoken, which takes a fifth of the time for the same ids.

    Strings of added tokens in a text get these tokens' ids, as the library has it
    unless told otherwise; without ``special`` they are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    names, known = byte_names(), {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(names[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in known}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=known if special else {})


@functools.cache
def library(path: str, special: bool = True):
    """The file in the tokenizers library itself: slower, and its matcher keeps no stack."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def encode(text: str, path: str, special: bool = True) -> np.ndarray:
    """The ids of a text. A run of about a million white-space characters exceeds the stack of tiktoken's matcher: the library encodes such a text."""
    try:
        return encoder(path, special).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return np.array(library(path, special).encode(text, add_special_tokens=False).ids, "<u4")


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, first_id: int) -> None:
        self.size, self.most, self.next = size, most, first_id
        self.open: list[tuple[int, list]] = []  # room left, pieces
        self.out: list[tuple] = []  # doc_id, start, ids, doc_tokens, sequence_id, offset

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[: self.size], total)])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            fit = min((k for k, (room, _) in enumerate(self.open) if room >= len(ids)), key=lambda k: self.open[k][0], default=None)
            if fit is None and len(self.open) < self.most:
                self.open.append((self.size, []))
                fit = len(self.open) - 1
            if fit is None:
                fit = min(range(len(self.open)), key=lambda k: self.open[k][0])
            room, pieces = self.open[fit]
            n = min(room, len(ids))
            pieces.append((doc, start, ids[:n], total))
            start, ids = start + n, ids[n:]
            if n == room:
                self.open.pop(fit)
                self.emit(pieces)
            else:
                self.open[fit] = (room - n, pieces)

    def rest(self) -> list:
        pieces = [p for _, window in self.open for p in window]
        self.open = []
        return pieces

    def close(self) -> None:
        """Emit all: whole windows, and the last rest at powers of two."""
        pieces = self.rest()
        left = sum(len(p[2]) for p in pieces)
        sizes = [self.size] * (left // self.size) + [1 << k for k in range(self.size.bit_length(), -1, -1) if left % self.size >> k & 1]
        k = 0
        for size in sizes:
            window = []
            while size:
                doc, start, ids, total = pieces[k]
                n = min(size, len(ids))
                window.append((doc, start, ids[:n], total))
                size -= n
                if n == len(ids):
                    k += 1
                else:
                    pieces[k] = (doc, start + n, ids[n:], total)
            self.emit(window)


_KIND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("done", pa.bool_())])
_SQL_KIND = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, done boolean"


def _rows(pieces: list, done: bool, ids: bool) -> pa.RecordBatch:
    doc, start, arrays, total, seq, at = zip(*pieces, strict=True) if pieces else [()] * 6
    raw = [x.tobytes() for x in arrays]
    kept = raw if ids or not done else [None] * len(raw)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, arrays), pa.int64()), pa.array(map(crc32, raw), pa.int64()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(at, pa.int64()), pa.array(kept, pa.binary()), pa.array([done] * len(raw), pa.bool_())], schema=_KIND)


def _pack(read: Callable[[pa.RecordBatch], Iterator[tuple]], size: int, most: int, level: int, ids: bool, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, most, level << 56 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            for piece in read(batch):
                packer.add(*piece)
                if len(packer.out) >= 4096:
                    yield _rows(packer.out, True, ids)
                    packer.out = []
        if last:
            packer.close()
        yield _rows(packer.out, True, ids)
        if rest := packer.rest():
            yield _rows([(*p, -1, -1) for p in rest], False, ids)

    return tidy(run)


def _texts(path: str, end_id: int, special: bool) -> Callable:
    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            ids = np.append(encode(text.as_py() or "", path, special), end_id).astype("<u4")
            yield doc, 0, ids, len(ids)

    return read


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    for doc, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
        yield doc, start, np.frombuffer(ids, "<u4"), total


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, open_windows: int = 16, end_id: int = 0, with_ids: bool = True, merge: int = 256, special: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the ids (little-endian 32-bit).

    A document is the ids of its text and ``end_id``; a null or empty text is
    ``end_id`` alone. A null id is packed like any other; so is each row of a
    repeated id. Windows hold ``size`` ids, but for a few at smaller powers of
    two at the very end. Other columns are ignored, whatever their names; an
    empty table, one without partitions too, gives an empty one. ``merge``:
    partitions whose open windows meet in one. ``special``: an added token's string
    in a text is that token, as in the tokenizers library by default; else it is
    ordinary text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    parts = max(1, base.rdd.getNumPartitions())  # a plan that is known to be empty has none
    level = scratch.table(base.mapInArrow(_pack(_texts(tokenizer, end_id, special), size, open_windows, 0, with_ids, False), _SQL_KIND), "level-0")
    done = [level.where("done")]
    for k in range(1, 64):
        parts = -(-parts // merge)
        rest = level.where("not done").drop("done")
        rest = rest.coalesce(1) if parts == 1 else rest.repartition(parts, "doc_id", "start")
        level = scratch.table(rest.mapInArrow(_pack(_pieces, size, open_windows, k, with_ids, parts == 1), _SQL_KIND), f"level-{k}")
        done.append(level.where("done"))
        if parts == 1:
            break
    out = functools.reduce(DataFrame.unionByName, done).drop("done").withColumnRenamed("doc_id", id_col)
    return out if with_ids else out.drop("ids")
