"""Quality rules: a linear-chain conditional random field labels lines, and their words decide.

Viterbi decoding marks each line as content or boilerplate; a text is kept if at
least ``content_share`` of its words stand in content lines and the base rules
hold. The field is trained here, on a bounded sample of labelled documents. Only
documents have labels, so lines get weak ones first: what a line looks like, by a
model of single lines that sums out their labels, and its document's label, which a
share of ``NOISE`` of the lines doesn't follow. So a clean line of a bad text is content
and a block of rubbish in a good one boilerplate. The field is then trained on whole
runs of these labels, and learns the steps from one to the other with the rest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cdrforge.llm.hashing import pieces
from cdrforge.llm.textstats import N_LINE_FEATURES, Stats, line_features, stats
from cdrforge.workers import tidy

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Share of lines whose label is not their document's.
NOISE = 0.1


class Field(NamedTuple):
    """Log potentials: line features for each label (0 boilerplate, 1 content), first label, and label to label."""

    weight: np.ndarray
    first: np.ndarray
    step: np.ndarray


#: Without labels of both kinds every line is content.
ALL_CONTENT = Field(np.zeros((N_LINE_FEATURES, 2)), np.array([-1e9, 0.0]), np.array([[0.0, 0.0], [-1e9, 0.0]]))


def viterbi(emit: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Best labels of all lines of many texts. ``emit``: lines by labels; ``first``: index of each text's first line.

    Texts step in unison, longest first, so that work follows the lines and not the longest text. Ties go to content.
    """
    long = np.diff(first)
    order = np.argsort(-long, kind="stable")
    begin, long = first[:-1][order], long[order]
    out = np.ones(len(emit), np.int8)
    if not len(emit):
        return out
    back = np.zeros((len(emit), 2), np.int8)
    score = emit[begin] + field.first
    live = len(begin)
    for t in range(1, int(long[0])):
        live = int(np.searchsorted(-long, -t))
        by = score[:live, :, None] + field.step
        best = (by[:, 1] >= by[:, 0]).astype(np.int8)
        back[begin[:live] + t] = best
        score[:live] = np.where(best == 1, by[:, 1], by[:, 0]) + emit[begin[:live] + t]
    label = (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t in range(int(long[0]) - 1, -1, -1):
        live = int(np.searchsorted(-long, -t))
        out[begin[:live] + t] = label[:live]
        label[:live] = back[begin[:live] + t, label[:live]]
    return out


def _marginals(e: np.ndarray, on: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each line's label, and sums over the lines of those of a label and the next one, for runs of lines side by side."""
    most = e.shape[1]
    up, down = np.zeros_like(e), np.zeros_like(e)
    up[:, 0] = e[:, 0] + field.first
    for t in range(1, most):
        new = np.logaddexp(up[:, t - 1, 0, None] + field.step[0], up[:, t - 1, 1, None] + field.step[1]) + e[:, t]
        up[:, t] = np.where(on[:, t, None], new, up[:, t - 1])
    for t in range(most - 2, -1, -1):
        right = down[:, t + 1] + e[:, t + 1]
        new = np.logaddexp(field.step[:, 0] + right[:, 0, None], field.step[:, 1] + right[:, 1, None])
        down[:, t] = np.where(on[:, t + 1, None], new, 0)
    z = np.logaddexp(up[:, -1, 0], up[:, -1, 1])
    single = np.exp(up + down - z[:, None, None]) * on[..., None]
    double = np.exp(up[:, :-1, :, None] + field.step + (e + down)[:, 1:, None, :] - z[:, None, None, None]) * on[:, 1:, None, None]
    return single, double.sum(1)


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1e-3, prior: float = 0.6, noise: float = NOISE) -> Field:
    """Weak labels of lines, and the field of most likelihood for them, both by gradient ascent (Adam).

    ``first``: index of each run's first line; ``label``: of each run's text; content weighs ``prior`` of all.
    """
    n, long = len(first) - 1, np.diff(first)
    most, width = int(long.max()), features.shape[1]
    x, on = np.zeros((n, most, width)), np.arange(most) < long[:, None]
    x[on] = features
    told = np.log(np.where(np.eye(2, dtype=bool), 1 - noise, noise))[label][:, None]
    weigh = (np.array([1 - prior, prior]) / np.maximum(np.bincount(label, minlength=2), 1))[label] / long

    def ascend(theta: np.ndarray, slope) -> np.ndarray:
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            grad = slope(theta) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return theta

    def odds(e: np.ndarray) -> np.ndarray:
        return np.exp(e - np.logaddexp(e[..., 0], e[..., 1])[..., None]) * on[..., None]

    def upward(theta: np.ndarray) -> np.ndarray:
        e = x @ theta.reshape(width, 2)
        return np.einsum("ntf,ntl,n->fl", x, odds(e + told) - odds(e), weigh, optimize=True).ravel()

    line = ascend(np.zeros(2 * width), upward)
    weak = odds(x @ line.reshape(width, 2) + told)
    pairs = np.einsum("nta,ntb,n->ab", weak[:, :-1], weak[:, 1:], weigh)  # a run's last line has no next one: that is 0

    def slope(theta: np.ndarray) -> np.ndarray:
        field = _field(theta)
        single, double = _marginals(x @ field.weight, on, field)
        return np.concatenate([np.einsum("ntf,ntl,n->fl", x, weak - single, weigh, optimize=True).ravel(), weigh @ (weak - single)[:, 0], (pairs - np.einsum("nab,n->ab", double, weigh)).ravel()])

    return _field(ascend(np.concatenate([line, np.zeros(6)]), slope))


def _field(theta: np.ndarray) -> Field:
    return Field(theta[:-6].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2))


def _sampled(run_lines: int, runs: int):
    """Runs of consecutive lines of each text, spread over the whole of it."""
    kind = pa.schema([("y", pa.int32()), ("lines", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                s = stats(batch.column("text"))
                f, first = line_features(s), s.lines.first
                y, rows = [], []
                for label, a, b in zip(batch.column("y").to_pylist(), first[:-1], first[1:], strict=True):
                    many = -(-(b - a) // run_lines)
                    for k in np.unique(np.linspace(0, many - 1, min(runs, many)).round().astype(int)):
                        y.append(label)
                        rows.append(f[a + k * run_lines : min(b, a + (k + 1) * run_lines)].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], schema=kind)

    return tidy(run)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 400, run_lines: int = 64, runs: int = 8) -> Field:
    """A field from ``sample`` documents of each label (those whose ids hash lowest).

    A document gives its lines in runs of ``run_lines``; of a longer one than
    ``runs`` of them, as many are taken at even distances over the whole text. The
    sample bounds the training only. Null ids and labels are left out; of an id
    with several labels the highest counts.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = [r for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if len({r["y"] for r in chosen}) < 2:
        return ALL_CONTENT
    known = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([marked.schema["id"], T.StructField("y", T.IntegerType())])))
    rows = docs.where(F.col(f"`{id_col}`").isin([r["id"] for r in chosen])).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(known, "id").select("y", "text")
    # the order of the sums must not depend on the order of the rows
    got = sorted((r["y"], r["lines"]) for r in rows.mapInArrow(_sampled(run_lines, runs), "y int, lines array<double>").collect())
    label = np.array([y for y, _ in got], np.int64)
    if len(set(label.tolist())) < 2:
        return ALL_CONTENT
    parts = [np.array(x).reshape(-1, N_LINE_FEATURES) for _, x in got]
    return fit(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), label)


def line_labels(s: Stats, field: Field) -> np.ndarray:
    """Of each line of many texts: 1 content, 0 boilerplate."""
    return viterbi(line_features(s) @ field.weight, s.lines.first, field)


def judge(s: Stats, label: np.ndarray, content_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, share of words in content lines, kept."""
    failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEATED_PERCENT * s.n_words)
    total = np.concatenate([[0], np.cumsum(s.lines.words * label)])
    share = (total[s.lines.first[1:]] - total[s.lines.first[:-1]]) / np.maximum(s.n_words, 1)
    return failed, share, ~failed & (share >= content_share)


VERDICT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("content_share", "double"), ("content_lines", T.ArrayType(T.BooleanType()))]


def _apply(field: Field, content_share: float, columns: list[str], text_col: str, only_kept: bool, lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col):
                s = stats(batch.column(text_col))
                label = line_labels(s, field)
                failed, share, kept = judge(s, label, content_share)
                out = batch.select(columns)
                if only_kept:
                    yield out.filter(pa.array(kept))
                    continue
                new = [pa.array(x) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept, share)]
                if lines:
                    new.append(pa.ListArray.from_arrays(s.lines.first.astype(np.int32), label.astype(bool)))
                yield pa.RecordBatch.from_arrays([*out.columns, *new], names=[*columns, *(c for c, _ in VERDICT[: len(new)])])

    return tidy(run)


def quality_rules(docs: DataFrame, field: Field, text_col: str = "text", columns: list[str] | None = None, content_share: float = 0.5, only_kept: bool = False, lines: bool = False) -> DataFrame:
    """The columns of ``docs`` (or those named) and the verdict, or with ``only_kept`` the rows that pass and no verdict.

    Verdict: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share and, with ``lines``, content_lines: for each
    line between line feeds whether it is content. A null or empty text has no
    words, one line, and fails the base rules. Rows are judged each on its own, so
    null and repeated ids and repeated rows need no care. Columns of ``docs`` that
    are named as one of the verdict's are replaced by it. An empty table gives an
    empty one.
    """
    verdict = VERDICT if lines else VERDICT[:-1]
    names = columns or docs.columns
    if not only_kept:
        names = [c for c in names if c not in {v for v, _ in verdict}]
    kept = {f.name: f for f in docs.schema.fields}
    need = list(dict.fromkeys([*names, text_col]))
    kind = T.StructType([kept[c] for c in names])
    if not only_kept:
        for c, t in verdict:
            kind = kind.add(c, t)
    return docs.select(*(F.col(f"`{c}`") for c in need)).mapInArrow(_apply(field, content_share, names, text_col, only_kept, lines), kind)


quality_filter = functools.partial(quality_rules, only_kept=True)
