"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised over the corpus and mapped to cosines whose
products approximate a Gaussian kernel. Each partition sums the normal equations
of its labelled rows; the sums are added up in a tree of tasks, and one matrix of
fixed size reaches the driver. Raw scores are calibrated by pooling adjacent
violators over a fixed grid of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.hashing import pieces
from cdrforge.llm.textstats import N_DOCUMENT_FEATURES, document_features, stats
from cdrforge.storage import Scratch

_GRID, _FAN = 4000, 16


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # of the random features
    b: np.ndarray
    beta: np.ndarray  # ridge weights, the last one for 1
    knots: np.ndarray  # raw scores
    values: np.ndarray  # calibrated ones


def random_features(d: int, size: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of a Gaussian kernel of the given width."""
    g = np.random.Generator(np.random.PCG64(seed))
    return g.standard_normal((d, size)) / width, g.uniform(0, 2 * np.pi, size)


def transform(x: np.ndarray, m: Model) -> np.ndarray:
    z = np.clip((x - m.mean) / m.scale, -5, 5)
    return np.concatenate([np.cos(z @ m.w + m.b) * np.sqrt(2 / m.w.shape[1]), np.ones((len(x), 1))], 1)


def pool(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: centres and values of the blocks."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x * weight, y * weight, weight, strict=True):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for whole in batches:
        for batch in pieces(whole, "text"):
            x = document_features(stats(batch.column("text")))
            cut = np.arange(len(x) + 1, dtype=np.int32) * N_DOCUMENT_FEATURES
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(cut, x.ravel())], schema=kind)


def _equations(m: Model):
    """Upper triangle of the partition's Z'Z with y as a last column, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = m.w.shape[1] + 2
        total = np.zeros((size, size))
        for batch in batches:
            z = np.concatenate([transform(_matrix(batch), m), batch.column("y").to_numpy()[:, None]], 1)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"s": [total[np.triu_indices(size)].tobytes()]})

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for s in batch.column("s").to_pylist():
            x = np.frombuffer(s)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})


def _raw(m: Model, calibrated: bool):
    kind = pa.schema([("id", pa.int64()), ("score", pa.float64()), *([] if calibrated else [("y", pa.float64())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = transform(_matrix(batch), m) @ m.beta
            if calibrated:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.interp(s, m.knots, m.values))], schema=kind)
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), batch.column("y")], schema=kind)

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, size: int = 256, width: float = 4.0, ridge: float = 1e-4, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Labels of rows with crc32(id as text) mod ``folds`` = ``held_out`` are not
    read. A null or empty text is scored as a text without words. Null labels and
    null ids are left out of the training; of an id with several labels the
    highest counts. Rows of one id are scored each on its own. Without labels of
    both kinds every score is the share of 1 among them, or 0.5. Other columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_features, "id long, x array<double>")
    rows = scratch.table(rows, "features")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_out, F.lit(False))
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y in (0, 1)").where(~held).groupBy("id").agg(F.max("y").alias("y"))
    known = scratch.table(rows.join(marked, "id"), "labelled")
    n, ones = known.agg(F.count("*"), F.sum("y")).first()
    w, b = random_features(N_DOCUMENT_FEATURES, size, width, seed)
    m = Model(np.zeros(N_DOCUMENT_FEATURES), np.ones(N_DOCUMENT_FEATURES), w, b, np.zeros(size + 1), np.zeros(1), np.full(1, ones / n if n else 0.5))
    if n and 0 < ones < n:
        of = [F.col("x")[i] for i in range(N_DOCUMENT_FEATURES)]
        seen = rows.agg(*map(F.avg, of), *map(F.stddev_pop, of)).first()
        m = m._replace(mean=np.array(seen[:N_DOCUMENT_FEATURES]), scale=np.maximum(np.array(seen[N_DOCUMENT_FEATURES:]), 1e-9))
        sums, parts = known.mapInArrow(_equations(m), "s binary"), known.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // _FAN)
            sums = sums.repartition(parts).mapInArrow(_sum, "s binary")
        upper = np.frombuffer(sums.first()["s"])
        total = np.zeros((size + 2, size + 2))
        total[np.triu_indices(size + 2)] = upper
        total += np.triu(total, 1).T
        a, c = total[:-1, :-1], total[:-1, -1]
        m = m._replace(beta=np.linalg.solve(a + ridge * n * np.diag([*np.ones(size), 0]), c))
        raw = known.mapInArrow(_raw(m, False), "id long, score double, y double")
        grid = F.round(F.least(F.greatest("score", F.lit(-0.5)), F.lit(1.5)) * (_GRID / 2)).cast("long")
        bins = sorted(raw.groupBy(grid.alias("g")).agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect())
        knots, values = pool(*(np.array([r[k] for r in bins], float) for k in ("g", "y", "n")))
        m = m._replace(knots=knots / (_GRID / 2), values=values)
    out = rows.mapInArrow(_raw(m, True), "id long, score double")
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
