"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

No piece of the vocabulary runs from another character into a space (a model with
such a piece is refused), so the lattice of a text falls apart before each run of spaces, and a run with what
follows it is sampled on its own. Forward sums are computed once for each distinct
unit of a batch, for all units in unison; backward sampling then draws the last
piece of every occurrence, the one before it, and so on. A draw is a hash of the
row's key and its place in the text: the same text under the same key is always
cut the same way, wherever it is processed.

The file's scores are merge ranks, not probabilities; a piece of rank r weighs
1 / (r + 2), as word frequencies do. Spaces are spaces: a space mark in a text is
spelled in bytes, as is every character without a piece, so decoding gives back
every text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.hashing import U, mix, pieces, powers

_BASE = U(0x9FB21C651E98DF25)
_LETTER = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE, _MARK = 32, "▁"
CHUNK = 4 << 20


class Vocabulary(NamedTuple):
    #: For each length in bytes: hashes of all starts of pieces, sorted, and the piece each is, or -1.
    starts: list[tuple[np.ndarray, np.ndarray]]
    score: np.ndarray
    byte: np.ndarray  # piece of each byte
    first: np.ndarray  # place of each byte among the starts of length 1
    raw: list[bytes]  # what each piece stands for


def _hash(raw: bytes) -> int:
    h = 0
    for b in raw:
        h = (h * int(_BASE) + int(_LETTER[b])) & 0xFFFFFFFFFFFFFFFF
    return h


@functools.cache
def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw: list[bytes] = [b""] * n
    score, byte = np.full(n, -np.inf), np.full(256, -1)
    tables: list[dict[int, int]] = [{}]
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            b = int(name[1:-1], 16)
            raw[i], byte[b] = bytes([b]), i
            score[i] = -alpha * np.log(2 * n + 2)
            continue
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        raw[i] = name.replace(_MARK, " ").encode()
        if _MARK in name.lstrip(_MARK):
            raise ValueError(f"{path}: the piece {name} runs from another character into a space")
        score[i] = -alpha * np.log(min(-model.get_score(i), n) + 2)
        for k in range(1, len(raw[i]) + 1):
            while len(tables) <= k:
                tables.append({})
            tables[k].setdefault(_hash(raw[i][:k]), -1)
        tables[len(raw[i])][_hash(raw[i])] = i
    starts = []
    for t in tables:
        keys = np.array(sorted(t), np.uint64)
        starts.append((keys, np.array([t[int(k)] for k in keys], np.int32)))
    keys = starts[1][0]
    return Vocabulary(starts, score, byte.astype(np.int32), np.minimum(np.searchsorted(keys, _LETTER), len(keys) - 1), raw)


def _edges(d: np.ndarray, room: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in the lattices: start, length, piece. ``room``: bytes to the unit's end."""
    at, h, out = np.arange(len(d), dtype=np.int32), np.zeros(len(d), np.uint64), []
    single = np.zeros(len(d), bool)  # a character that has a piece of its own begins here
    size = np.select([d < 0x80, d < 0xC0, d < 0xE0, d < 0xF0], [1, 0, 2, 3], 4).astype(np.int8)
    for k in range(1, len(v.starts)):
        use = room[at] >= k
        at, h = at[use], h[use]
        h = h * _BASE + _LETTER[d[at + (k - 1)]]
        keys, found = v.starts[k]
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if k > 1 else v.first[d[at]]
        known = keys[where] == h
        at, h, piece = at[known], h[known], found[where[known]]
        whole = piece >= 0
        begin = at[whole]
        out.append((begin, np.full(len(begin), k, np.int32), piece[whole]))
        single[begin[size[begin] == k]] = True
        if not len(at):
            break
    lead = np.maximum.accumulate(np.where(size > 0, np.arange(len(d)), 0))
    bare = np.flatnonzero(~single[lead]).astype(np.int32)
    out.append((bare, np.ones(len(bare), np.int32), v.byte[d[bare]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def running(value: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Running sums within groups that begin at ``lead``, each added up on its own: what stands round a group doesn't touch its sums."""
    out, size = value.copy(), np.diff(lead, append=len(value))
    for k in range(1, int(size.max(initial=0))):
        lead, size = lead[size > k], size[size > k]
        out[lead + k] += out[lead + k - 1]
    return out


def sample(texts: list[bytes], keys: np.ndarray, v: Vocabulary) -> list[np.ndarray]:
    """Piece ids of each text under its key (a 64-bit number)."""
    full = [b" " + t if t else b"" for t in texts]
    data = np.frombuffer(b"".join(full), np.uint8)
    size = np.array([len(t) for t in full])
    begin = np.cumsum(size) - size
    if not len(data):
        return [np.zeros(0, np.int32) for _ in texts]
    space = data == _SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[begin[size > 0]] = True
    start = np.flatnonzero(cut)
    long = np.diff(start, append=len(data))
    inside = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), long)
    h = mix(np.add.reduceat(_LETTER[data] * powers(int(long.max()))[inside], start) ^ long.astype(np.uint64))
    # occurrences by unit, and the distinct units one after another
    by = np.argsort(h)
    fresh = np.ones(len(by), bool)
    fresh[1:] = h[by[1:]] != h[by[:-1]]
    first, unit = by[fresh], np.cumsum(fresh) - 1
    n = long[first]
    at = (np.cumsum(n) - n).astype(np.int32)
    offset = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(at, n)
    d = data[np.repeat(start[first], n) + offset]
    a, k, piece = _edges(d, np.repeat(n.astype(np.int32), n) - offset, v)
    order = np.argsort(a + k, kind="stable")
    t = (offset[a] + k)[order]
    order = order[np.argsort(t.astype(np.uint16) if int(n.max()) < 1 << 16 else t, kind="stable")]
    a, k, piece = a[order], k[order], piece[order]
    end = a + k
    t = offset[a] + k
    new = np.ones(len(end), bool)
    new[1:] = (end[1:] != end[:-1]) | (t[1:] != t[:-1])
    lead = np.flatnonzero(new)
    group = (np.cumsum(new) - 1).astype(np.int32)
    score, inner = v.score[piece], k < t
    # forward sums by end; the start of a unit has 0
    total = np.zeros(len(d) + 1)
    value = np.empty(len(end))
    steps = np.searchsorted(t, np.arange(1, int(t[-1]) + 2))
    for lo, hi in zip(steps[:-1], steps[1:], strict=True):
        if lo == hi:
            continue
        x = score[lo:hi] + np.where(inner[lo:hi], total[a[lo:hi]], 0.0)
        g = lead[group[lo] : group[hi - 1] + 1] - lo
        in_g = group[lo:hi] - group[lo]
        top = np.maximum.reduceat(x, g)
        e = np.exp(x - top[in_g])
        s = np.add.reduceat(e, g)
        total[end[lo + g]] = top + np.log(s)
        value[lo:hi] = e / s[in_g]
    below = running(value, lead)
    below[np.append(lead[1:], len(end)) - 1] = 1.0
    of = np.zeros(len(d) + 1, np.int32)
    of[end[lead]] = lead
    # backward draws, for all occurrences in unison
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.append(begin, len(data)))))
    stop = at[unit]
    here = stop + n[unit].astype(np.int32)
    where, seed, zero = (start + long)[by].astype(np.int32), mix(keys)[doc][by], begin[doc][by].astype(np.int32)
    token = np.full(len(data) + 1, -1, np.int32)
    while len(here):
        draw = (mix(seed ^ mix((where - zero).astype(np.uint64))) >> U(11)).astype(np.float64) * 2.0**-53
        e = of[here]
        more = np.flatnonzero(below[e] <= draw)
        while len(more):
            e[more] += 1
            more = more[below[e[more]] <= draw[more]]
        token[where] = piece[e]
        step = k[e]
        here, where = here - step, where - step
        go = here > stop
        here, stop, where, seed, zero = here[go], stop[go], where[go], seed[go], zero[go]
    got = token >= 0
    flat, at_end = token[got], np.flatnonzero(got)
    low = np.searchsorted(at_end, begin + 1)
    high = np.searchsorted(at_end, begin + size + 1)
    return [flat[x:y] for x, y in zip(low, high, strict=True)]


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of the pieces, byte for byte."""
    raw = b"".join(map(v.raw.__getitem__, ids.tolist()))
    return raw[1:]


def _run(path: str, alpha: float, seed: int, with_ids: bool):
    kind = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("lossless", pa.bool_()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, alpha)
        for whole in batches:
            for batch in pieces(whole, "text", CHUNK):
                texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
                ids = batch.column("id").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
                got = sample(texts, ids ^ U(seed), v)
                back = [decode(x, v) for x in got]
                columns = [batch.column("id"), pa.array(map(len, got), pa.int64()), pa.array([crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()), pa.array(map(crc32, back), pa.int64()), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]
                if with_ids:
                    columns.append(pa.array(got, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_crc32 (of little-endian 32-bit ids), decoded_crc32, lossless and, if asked for, ids.

    ``alpha`` sharpens (above 1) or flattens the distribution of segmentations. A
    null or empty text has no pieces. Rows of one id and text are cut alike; a
    null id is the key 0. Other columns are ignored, whatever their names; an
    empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = "id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_run(model, alpha, seed, with_ids), kind).withColumnRenamed("id", id_col)


def decode_rows(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows with ids; null ids of pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [None if x is None else decode(np.array(x, np.int64), v) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
