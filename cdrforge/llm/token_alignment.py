"""Which tokens of two tokenizers stand for the same bytes.

A marks the ends of its tokens in a bitset over the text's bytes, B in another one.
Their AND holds the shared cuts, a population count up to a cut gives the token that
ends there (rank), and the tokens between two shared cuts are one group of A's linked
with one of B's. Texts of a batch stand one after another in the same bitset, since
both tokenizers end a token at each text's end; so all steps run over whole batches.
A text longer than a batch is taken in parts that begin where both must end a token.

A link's count is the number of documents that hold its pair of ids linked. The pairs
of a document fit an integer each and are written once. Those counted most often (a
bounded number of them, about ``hot``) are looked up in a table that every task gets;
all others are joined, so that no join key is held by many rows. Exact either way.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.hashing import pieces
from cdrforge.llm.packing import byte_names, encoder, library
from cdrforge.storage import Scratch

_MARK, _CUT = "▁", re.compile(rb"(?<=[!-~]) (?=[!-~])")
CHUNK = 1 << 20
#: Links that are expanded at a time, and distinct ones that are kept before they are merged.
_LINKS = 1 << 20


class Side(NamedTuple):
    raw: list[bytes]  # what each id stands for
    size: np.ndarray  # its bytes
    text: list[bytes]  # "id," and "id" with the mark that ends its side of a group, one after another
    apart: bool  # no token runs from another character into a space


def _side(raw: list[bytes], mark: bytes) -> Side:
    apart = not any(b" " in r.lstrip(b" ") for r in raw)
    return Side(raw, np.array([len(r) for r in raw]), [x for i in range(len(raw)) for x in (b"%d," % i, b"%d" % i + mark)], apart)


@functools.cache
def side_a(path: str) -> Side:
    """A byte-level BPE file: entries decoded by the letters that stand for bytes."""
    names, vocab = byte_names(), library(path, False).get_vocab()
    raw = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        raw[i] = bytes(names[c] for c in entry)
    return _side(raw, b"|")


@functools.cache
def model_b(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def side_b(path: str) -> Side:
    model = model_b(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return _side([bytes([int(x[3:-1], 16)]) if model.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)], b";")


def encode_a(text: str, path: str) -> np.ndarray:
    """Ids without special tokens; a run of white space that exceeds the stack of tiktoken's matcher is left to the library."""
    try:
        return encoder(path, False).encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    except ValueError:
        return np.array(library(path, False).encode(text, add_special_tokens=False).ids, np.uint32)


def bits(ends: np.ndarray, n: int) -> np.ndarray:
    """A packed bitset of ``n`` bytes: bit i is set if a token ends after byte i."""
    marks = np.zeros(-(-n // 64) * 64, bool)
    marks[ends - 1] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """The places of all set bits, each plus one."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 1


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set before each of ``at``."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    part = np.append(words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return before[word] + np.bitwise_count(part)


def expand(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, owner: np.ndarray, n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of groups, about ``_LINKS`` at a time: owner, pair (a * n_b + b) and how often, in order of owners; one may come several times."""
    n_a, m = np.diff(first_a), np.diff(first_b)
    total = n_a * m
    upto = np.cumsum(total)
    lo = 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _LINKS, "right")))
        if hi == lo + 1 and total[lo] > _LINKS:  # one group too large to expand: distinct ids in blocks
            (xs, xn), (ys, yn) = (np.unique(ids[f[lo] : f[lo + 1]], return_counts=True) for ids, f in ((a, first_a), (b, first_b)))
            step = max(1, _LINKS // len(ys))
            for k in range(0, len(xs), step):
                pair = (xs[k : k + step, None].astype(np.int64) * n_b + ys[None, :]).ravel()
                yield np.full(len(pair), owner[lo]), pair, (xn[k : k + step, None] * yn[None, :]).ravel()
        else:
            size = total[lo:hi]
            group = np.repeat(np.arange(lo, hi), size)
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            pair = a[first_a[group] + k // m[group]].astype(np.int64) * n_b + b[first_b[group] + k % m[group]]
            yield owner[group], pair, np.ones(len(pair), np.int64)
        lo = hi


def distinct(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each owner's distinct pairs and how often each occurs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # owner << 32 | pair, and times

    def merge() -> None:
        key, n = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(key):
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[first], np.add.reduceat(n, first)
        held[:] = [(key, n)]

    fresh = 0
    for owner, pair, n in parts:
        held.append((owner << 32 | pair, n))
        fresh += len(pair)
        if fresh > 4 * _LINKS:
            merge()
            fresh = 0
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    merge()
    key, n = held[0]
    return key >> 32, key & 0xFFFFFFFF, n


def segments(full: bytes, most: int) -> Iterator[bytes]:
    """A text (with the space before it) in parts of about ``most`` bytes, each beginning with a space between two visible ASCII characters.

    There both tokenizers end a token, whatever stands round it: no word of A's pattern
    goes on into a space, no piece of B does, and what follows depends on nothing before.
    """
    at = 0
    while len(full) - at > most and (m := _CUT.search(full, at + most)):
        yield full[at : m.start()]
        at = m.start()
    yield full[at:]


def _aligned_parts(full: list[bytes], path_a: str, path_b: str) -> list[tuple | None]:
    """Of each part n_a, n_b, n_groups, n_links, the digest's text, distinct pairs and how often each is linked; None if a tokenizer doesn't give it back."""
    va, vb = side_a(path_a), side_b(path_b)
    strings = [t.decode("utf-8", "replace") for t in full]
    ids_a = [encode_a(s, path_a) for s in strings]
    ids_b = [np.array(x, np.int64) for x in model_b(path_b).encode([s[1:] for s in strings], num_threads=1)]
    joined = lambda ids, v: b"".join(map(v.raw.__getitem__, ids.tolist()))
    good = [k for k in range(len(full)) if joined(ids_a[k], va) == full[k] == joined(ids_b[k], vb)]
    out: list[tuple | None] = [None] * len(full)
    if not good:
        return out
    a, b = np.concatenate([ids_a[k] for k in good]).astype(np.int64), np.concatenate([ids_b[k] for k in good])
    size = np.cumsum([len(full[k]) for k in good])
    bits_a, bits_b = bits(np.cumsum(va.size[a]), int(size[-1])), bits(np.cumsum(vb.size[b]), int(size[-1]))
    cuts = select(bits_a & bits_b)
    first_a, first_b = (np.concatenate([[0], rank(x, cuts)]) for x in (bits_a, bits_b))
    last = np.searchsorted(cuts, size) + 1  # groups up to each part's end
    owner = np.searchsorted(size, cuts)
    whose, pair, times = distinct(expand(a, b, first_a, first_b, owner, len(vb.raw)))
    bounds = np.searchsorted(whose, np.arange(len(good) + 1))
    # the digest's text: A's side of a group, B's side, A's side of the next one
    final_a, final_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    final_a[first_a[1:] - 1] = final_b[first_b[1:] - 1] = 1
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + np.repeat(first_b[:-1], n_a)] = 2 * a + final_a
    code[np.arange(len(b)) + np.repeat(first_a[1:], n_b)] = 2 * (b + len(va.raw)) + final_b
    words = va.text + vb.text
    links = np.concatenate([[0], np.cumsum(n_a * n_b)])
    lo = 0
    for k, hi in enumerate(last.tolist()):
        text = b"".join(map(words.__getitem__, code[first_a[lo] + first_b[lo] : first_a[hi] + first_b[hi]].tolist()))
        mine = slice(bounds[k], bounds[k + 1])
        out[good[k]] = (int(first_a[hi] - first_a[lo]), int(first_b[hi] - first_b[lo]), hi - lo, int(links[hi] - links[lo]), text[:-1], pair[mine], times[mine])
        lo = hi
    return out


class _Sum:
    """What the parts of one text come to."""

    def __init__(self) -> None:
        self.n, self.sha, self.sound = np.zeros(4, np.int64), hashlib.sha256(), True
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, part: tuple | None) -> None:
        if part is None or not self.sound:
            self.sound = False
            return
        if self.n[0]:
            self.sha.update(b";")
        self.sha.update(part[4])
        self.n += part[:4]
        self.held.append((np.zeros(len(part[5]), np.int64), part[5], part[6]))
        if sum(len(x) for _, x, _ in self.held[1:]) > 4 * _LINKS:
            self.held = [distinct(iter(self.held))]

    def row(self) -> tuple:
        if not self.sound or not self.n[0]:
            return (0, 0, 0, 0, "", None, None)
        _, pair, times = self.held[0] if len(self.held) == 1 else distinct(iter(self.held))
        return (*self.n.tolist(), self.sha.hexdigest(), pair.astype(np.int32), times)


def align(texts: list[bytes | None], path_a: str, path_b: str, most: int = CHUNK) -> Iterator[tuple]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with how often each is linked; long texts in parts of about ``most`` bytes."""
    sums = [_Sum() for _ in texts]
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        for (k, _), part in zip(held, _aligned_parts([x for _, x in held], path_a, path_b), strict=True):
            sums[k].add(part)
        held.clear()

    for k, text in enumerate(texts):
        for part in segments(b" " + text, most if side_b(path_b).apart else len(text) + 1) if text else ():
            held.append((k, part))
            if sum(len(x) for _, x in held) >= most:
                flush()
    flush()
    return (x.row() for x in sums)


_KIND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                got = zip(*align(batch.column("text").cast(pa.binary()).to_pylist(), path_a, path_b), strict=True)
                columns = [pa.array(x, t) for x, (_, t) in zip(got, _KIND, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *columns], names=["row", "id", *(n for n, _ in _KIND)])

    return run


_SUMS = ["row", "pair", "times", "count_sum", "n_best"]


def _looked_up(table):
    """Sums over the pairs in the table as one row of a document, and each other pair as a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            lists = [batch.column(c) for c in ("pairs", "times")]
            pair, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            of = np.repeat(batch.column("row").to_numpy(), lists[0].value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hot = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            row, first = np.unique(of[hot], return_index=True)
            sums = [np.add.reduceat(x, first) if len(first) else x for x in ((times * count[at])[hot], (times * best[at])[hot])] if len(known) else [pair[:0], pair[:0]]
            rest = np.flatnonzero(~hot)
            none = -1 - row % (1 << 31)  # no pair's number, and spread like the rows: an equal number would be a hot key of the join
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(none.astype(np.int32)), pa.nulls(len(row), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=_SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(of[rest]), pa.array(pair[rest].astype(np.int32)), pa.array(times[rest]), *[pa.nulls(len(rest), pa.int64())] * 2], names=_SUMS)

    return run


def alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (a * pieces of B + b) with ``times``: one row per row of ``docs``.

    A null or empty text, and one that either tokenizer doesn't give back byte for
    byte, has no tokens: zeros, an empty digest, no pairs.
    """
    if len(side_a(tokenizer_a).raw) * len(side_b(tokenizer_b).raw) > 1 << 31:
        raise ValueError("pairs of ids must fit an integer")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_aligned(tokenizer_a, tokenizer_b), "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, count (rows of ``aligned`` that hold it) and best (whether it is the highest count of its A id, ties included)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = Scratch(aligned.sparkSession, "pair-counts").table(counts.withColumn("a", F.expr(f"cast(pair div {n_b} as int)")), "counts")
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs counted most often, ``most`` at most: those of count classes (an exponent and three bits) that fit as a whole."""
    level = F.expr("cast(floor(8 * log2(count)) as int)")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # some hundred rows
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(level >= least).toArrow().sort_by("pair")
    pair, count, best = (got.column(c).to_numpy() for c in ("pair", "count", "best"))
    return pair.astype(np.int64), count, best.astype(np.int64)


def token_alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens of A (a byte-level BPE file, over space + text) and of B (a sentencepiece
    model, which adds the space) are grouped between the byte offsets where both end a
    token; each A of a group is linked with each B of it. A link's count is the number of
    rows that hold its pair of ids linked; n_best counts the links whose count is the
    highest of their A id (ties included), count_sum adds up all links' counts.

    A null or empty text, and one whose tokens don't give it back byte for byte, has
    zeros and an empty digest. Rows of a repeated id, and repeated rows, count each for
    itself; a null id is kept. Other columns are ignored, whatever their names; an empty
    table gives an empty one. ``hot``: pairs that every task gets at most, 24 bytes each.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = scratch.table(alignment(docs, tokenizer_a, tokenizer_b, id_col, text_col), "aligned")
    counts = scratch.table(pair_counts(aligned, len(side_b(tokenizer_b).raw)), "counts")
    table = docs.sparkSession.sparkContext.broadcast(_hot(counts, hot))
    parts = aligned.where("pairs is not null").select("row", "pairs", "times").mapInArrow(_looked_up(table), "row long, pair int, times long, count_sum long, n_best long")
    links = parts.join(counts, "pair", "left").select("row", F.coalesce("count_sum", F.col("times") * F.col("count")).alias("count_sum"), F.coalesce("n_best", F.when(F.col("best"), F.col("times"))).alias("n_best"))
    sums = links.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
