"""Pairs of near sequences in a join key that says little, compared as products of matrices.

Where the members of a large key are alike in most places, as in a family, a longer key
leaves most of its pairs and only multiplies its rows. So the key's rows are dealt into
tiles, and a task compares two tiles at a time: places that are equal are counted by the
product of two 0/1 matrices, a slab of letters and some rows at a time. All pairs of the
key are compared, each once; memory is that of two tiles.

Families far from each other are told apart before (``Balls``): by the triangle inequality
a row is near no member of a ball whose centre is farther off than the ball's radius and
the places that may differ. That leaves out no pair.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cdrforge.functions.sequences import PLACES

#: Rows and letters of a matrix, and the rows of it that are multiplied at a time.
_ROWS, _LETTERS, _PIECE = 4096, 1024, 256
#: Pairs from which balls are looked for, and their numbers as long as each leaves at most this share of the pairs that the one before left.
_SMALL, _CENTRES, _GAIN = 1 << 24, (64, 256), 0.6
#: Partitions of tiles to a core, and pairs that go out together.
_PARTS, _PAIRS = 4, 1 << 17


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of a column's values; null is a value like others."""
    return pa.concat_arrays(column.chunks or [pa.array([], column.type)]).dictionary_encode(null_encoding="encode").indices.to_numpy()


def letters(longs: list[np.ndarray], packed: bool = False) -> np.ndarray:
    """Rows of bytes from columns of longs of seven bytes each, or of 31 places."""
    if packed:
        shifts = np.arange(2 * (PLACES - 1), -1, -2)
        return np.concatenate([((w[:, None] >> shifts) & 3).astype(np.uint8) for w in longs], 1)
    return np.stack(longs, 1).astype(">i8").view(np.uint8).reshape(len(longs[0]), len(longs), 8)[:, :, 1:].reshape(len(longs[0]), -1)


class Balls:
    """Rows of ``a`` around centres, each of which is the row farthest from those before; one ball of all where that leaves out too little of ``b``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, most: int) -> None:
        self.order, self.ends, self.to_b, self.reach = np.arange(len(a)), np.array([len(a)]), None, None
        if len(a) * len(b) < _SMALL:
            return
        x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        nearest, home, to_b = np.full(len(a), np.iinfo(np.int16).max, np.int16), np.zeros(len(a), np.int16), []
        before = len(a) * len(b)
        for centres in _CENTRES:
            while len(to_b) < centres:
                centre = a[int(nearest.argmax()), :, None]
                d = (x != centre).sum(0, dtype=np.int16)
                home[d < nearest] = len(to_b)
                nearest = np.minimum(d, nearest)
                to_b.append((y != centre).sum(0, dtype=np.int16))
            reach = np.full(centres, most, np.int16)
            np.maximum.at(reach, home, nearest + most)
            size = np.bincount(home, minlength=centres)
            left = sum(int(n) * int(np.count_nonzero(d <= r)) for n, d, r in zip(size, to_b, reach, strict=True))
            if left > _GAIN * before:  # so many centres cost more than they save
                return
            before, self.order, self.ends, self.to_b, self.reach = left, np.argsort(home, kind="stable"), np.cumsum(size), list(to_b), reach

    def pieces(self, i: int, size: int, j: int, to: int) -> Iterator[tuple[slice, np.ndarray | slice]]:
        """Of ``size`` rows in order from ``i`` on, those of one ball at a time, and which of the rows ``j`` to ``to`` of ``b`` may be near one of them."""
        for k in range(int(np.searchsorted(self.ends, i, "right")), len(self.ends)):
            low, high = max(i, int(self.ends[k - 1]) if k else 0), min(i + size, int(self.ends[k]))
            if low >= i + size:
                return
            others = slice(None) if self.to_b is None else np.flatnonzero(self.to_b[k][j:to] <= self.reach[k])
            if self.to_b is None or len(others):
                for at in range(low, high, _PIECE):
                    yield slice(at - i, min(at + _PIECE, high) - i), others


def near(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` that differ in at most ``most`` places, in parts of bounded size."""
    varied = np.flatnonzero((a != a[:1]).any(0) | (b != a[:1]).any(0))
    at = np.arange(len(varied)) * 256
    x, y = at + a[:, varied], at + b[:, varied]
    seen = np.zeros((2, 256 * len(varied)), bool)
    seen[0, x], seen[1, y] = True, True
    both = seen.all(0)
    number = np.where(both, np.cumsum(both) - 1, -1).astype(np.int32)
    n, x, y = int(both.sum()), number[x], number[y]
    balls = Balls(a, b, most)

    def spread(z: np.ndarray) -> list[np.ndarray]:
        out = []
        for low in range(0, max(n, 1), _LETTERS):
            size = min(_LETTERS, n - low)
            ones = np.zeros((len(z), size + 1), np.float32)
            ones[np.arange(len(z))[:, None], np.where((z >= low) & (z < low + size), z - low, size)] = 1
            out.append(ones[:, :size])
        return out

    for i in range(0, len(x), _ROWS):
        rows = balls.order[i : i + _ROWS]
        left = spread(x[rows])
        for j in range(0, len(y), _ROWS):
            right = spread(y[j : j + _ROWS])
            for some, others in balls.pieces(i, len(rows), j, j + _ROWS):
                equal = functools.reduce(np.add, (p[some] @ q[others].T for p, q in zip(left, right, strict=True)))
                p, q = np.divmod(np.flatnonzero(equal >= len(varied) - most), equal.shape[1])
                if len(p):
                    yield rows[some][p], (q if isinstance(others, slice) else others[q]) + j


def _of(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def text_letters(texts: pa.ChunkedArray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts of each length in bytes, and their rows of bytes."""
    sizes = pc.binary_length(texts).to_numpy()[places]
    for size in np.unique(sizes):
        at = places[sizes == size]
        data = pa.concat_arrays(texts.take(pa.array(at)).chunks).cast(pa.large_binary())
        begin = np.frombuffer(data.buffers()[1], np.int64)[data.offset]
        yield at, np.frombuffer(data.buffers()[2] or b"", np.uint8, len(at) * int(size), int(begin)).reshape(len(at), int(size))


def compare(rows: DataFrame, longs: list[str] | str, most: str, met: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], pa.RecordBatch]], kind: StructType, packed: bool = False) -> DataFrame:
    """What ``met`` makes of the pairs in each tile (k, x, y).

    A row with ``side`` 0 meets those with ``side`` 1, and rows with ``side`` 2 each other,
    each two once. ``longs``: the columns of a sequence, or the one that holds it as a text, of which
    places beyond the shorter one of two differ from none; ``most``: a column with the places
    that may differ, the same for all rows of a key. ``met`` gets a tile's rows, and what it
    returns gets the places of both ends in them, in parts.
    """

    def laid_out(table: pa.Table, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        if isinstance(longs, str):
            return list(text_letters(table.column(longs), places))
        return [(places, letters(_of(table.take(places), longs), packed))]

    def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side, limit = table.column("side").to_numpy(), int(table.column(most)[0].as_py())
        for left, right in ((0, 1), (2, 2)):
            i, j = (np.flatnonzero(side == s) for s in (left, right))
            if not len(i) or not len(j):
                continue
            ones = laid_out(table, i)
            others = ones if left == right else laid_out(table, j)
            for (i, a), (j, b) in itertools.product(ones, others):
                shared = min(a.shape[1], b.shape[1])
                for p, q in near(a[:, :shared], b[:, :shared], limit):
                    p, q = i[p], j[q]
                    yield (p[p < q], q[p < q]) if left == right else (p, q)

    def tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
        made, held, n = None, [], 0
        for pair in pairs(table):
            held.append(pair)
            n += len(pair[0])
            if n >= _PAIRS:
                made = made or met(table)
                yield made(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            made = made or met(table)
            yield made(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack(_of(batch, ["k", "x", "y"]))
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and now != tuple(keys[:, a]):
                    yield from tile(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = tuple(keys[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from tile(pa.Table.from_batches(held).combine_chunks())

    # a tile's work says nothing of its bytes: a number is given, so that small partitions are not put together
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _PARTS * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(run, kind)
