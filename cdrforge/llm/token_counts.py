"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where they agree.

A chunk is encoded together with the first bytes of the next one, and these first
bytes are encoded on their own as well, as the next chunk begins with them. Each
encoding gives the offsets at which its tokens end. A common offset is a splice if it
is proven stable: nothing before it changes what comes after it, and the other way
round. For byte-level vocabularies that holds where one word of the pattern must end
whatever stands round it, between

- a letter and anything but a letter,
- a digit and anything but a digit,
- anything but white space and white space,

since no alternative of the pattern goes on over such a place, no merge crosses words,
and the pattern looks at what follows only. Added tokens may cross it, but then it is
no token's end in the chunk that holds the whole token; splices keep the longest
token's length away from a window's end, so that each such token is seen whole.

Each chunk then gives the tokens it has up to its splice less those that the next
chunk has up to there, and the last chunk gives all of its own; a text's tokens are
their sum. An overlap without a splice is widened, up to ``widest`` in the same task,
and after that by the whole next chunk (and so on), down to the text's end.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.packing import encode, encoder, library
from cdrforge.storage import Scratch

_OLD = unicodedata.ucd_3_2_0  # a character's kind that has stood since then is the same in every library
_BLANK = " \t\n\r"


@functools.cache
def lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    known = encoder(path)
    out = np.zeros(known.n_vocab, np.int64)
    for raw in known.token_byte_values():
        out[known.encode_single_token(raw)] = len(raw)
    for special in known.special_tokens_set:
        out[known.encode_single_token(special)] = len(special.encode())
    return out


@functools.cache
def reach(path: str) -> int:
    """How far from a window's end its tokens may differ from those of a longer window: the longest added token or contraction."""
    added = library(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError(f"{path}: added tokens that take in what stands round them")
    return max([4, *(len(t.content.encode()) for t in added)])


def _kind(c: str) -> str:
    """First letter of the character's category, if it has always been that; else nothing."""
    old, new = _OLD.category(c)[0], unicodedata.category(c)[0]
    return old if old == new and old != "C" or c < " " else ""


def stable(x: str, y: str) -> bool:
    """Whether a word ends between two characters in every text."""
    a, b = _kind(x), _kind(y)
    if not a or not b:
        return False
    return a in "LN" and a != b or not x.isspace() and a != "Z" and y in _BLANK


def _text(data: bytes, first: bool) -> str:
    """Whole characters of a window: bytes of one that began before it, or goes on after it, are left out."""
    begin, end = 0, len(data)
    while not first and begin < min(3, end) and data[begin] & 0xC0 == 0x80:
        begin += 1
    for k in range(1, min(4, end) + 1):
        if data[-k] & 0xC0 != 0x80:
            if data[-k] >= 0xC0 and k < (2 if data[-k] < 0xE0 else 3 if data[-k] < 0xF0 else 4):
                end -= k
            break
    return data[begin:end].decode("utf-8", "replace")


def splice(left: str, right: str, path: str, to_the_end: bool) -> int | None:
    """Tokens of ``left`` less those of ``right``, a tail of it, up to a place where both agree for certain; None if there is none.

    ``to_the_end``: both end where their text does, and agree there at the latest.
    """
    if not left.endswith(right):
        return None
    a, b = (np.cumsum(lengths(path)[encode(x, path).astype(np.int64)]) for x in (left, right))
    if to_the_end:
        return len(a) - len(b)
    if not len(b) or not len(a):
        return None
    common, i, j = np.intersect1d(a - (a[-1] - b[-1]), b, assume_unique=True, return_indices=True)
    data = right.encode()
    for at, m, n in zip(common, i, j, strict=True):
        if at + reach(path) > len(data):
            break
        # a token's end within a character is none between two
        if data[at] & 0xC0 != 0x80 and stable(data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1], data[at : at + 4].decode("utf-8", "ignore")[0]):
            return int(m - n)
    return None


def seam(data: bytes, cut: int, first: bool, to_the_end: bool, path: str, overlaps: list[int]) -> tuple[int | None, int]:
    """What a chunk of ``cut`` bytes adds to its text's tokens, with the overlap that this took; ``data`` goes on after it."""
    if len(data) <= cut and to_the_end:
        return len(encode(_text(data, first), path)), 0
    for o in overlaps:
        ends = to_the_end and cut + o >= len(data)
        got = splice(_text(data[: cut + o], first), _text(data[cut : cut + o], False), path, ends)
        if got is not None or cut + o >= len(data):
            return got, o
    return None, overlaps[-1]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            n = [len(encode(_text(t.as_py() or b"", True), path)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def _seams(path: str, chunk: int, overlaps: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("part"), batch.column("k").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)
            got = [seam(data := part.as_py(), chunk, k == 0, k * chunk + len(data) == n, path, overlaps) for part, k, n in rows]
            columns = [*(batch.column(c) for c in ("row", "k", "id", "n_bytes")), pa.array([x for x, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "k", "id", "n_bytes", "n", "overlap"])

    return run


def _merged(path: str, chunk: int, overlaps: list[int]):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        parts, k, n = group.column("part").to_pylist(), group.column("k")[0].as_py(), group.column("n_bytes")[0].as_py()
        data = b"".join([*(p[:chunk] for p in parts[:-1]), parts[-1]])
        got, _ = seam(data, len(parts) * chunk, k == 0, k * chunk + len(data) == n, path, overlaps)
        if got is None:
            raise RuntimeError("a stable boundary was lost in a longer window")
        return pa.table({"row": group.column("row")[:1], "n": pa.array([got], pa.int64())})

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 1 << 16, overlap: int = 1 << 10, widest: int = 1 << 13) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens (as the tokenizers library gives them, added tokens' strings included), over_limit (more than ``limit`` tokens).

    Texts of more than ``chunk`` bytes are spread over tasks by chunk. A null or empty
    text has no bytes and no tokens. Rows of a repeated or null id are counted each for
    itself. Other columns are ignored, whatever their names; an empty table gives an
    empty one. Of an invalid UTF-8 text the tokens are those of its replacement.
    A stretch in which no boundary is certain, such as a million equal letters, is one
    unit, encoded in one task.
    """
    if not reach(tokenizer) <= overlap <= widest <= chunk:
        raise ValueError("overlaps must hold the longest added token and not exceed a chunk")
    overlaps = [overlap]
    while overlaps[-1] < widest:
        overlaps.append(min(8 * overlaps[-1], widest))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_bytes"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.where(F.col("n_bytes") <= chunk).mapInArrow(_counts(tokenizer), f"id {kind}, n_bytes long, n_tokens long")

    scratch = Scratch(docs.sparkSession, "token-counts")
    last = F.expr(f"cast((n_bytes - 1) div {chunk} as int)")
    cut = rows.where(F.col("n_bytes") > chunk).withColumn("row", F.monotonically_increasing_id()).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    part = F.substring(F.col("text").cast("binary"), F.col("k") * chunk + 1, F.lit(chunk + widest)).alias("part")
    windows = scratch.table(cut.select("row", "k", "id", "n_bytes", part), "windows")
    found = windows.mapInArrow(_seams(tokenizer, chunk, overlaps), f"row long, k int, id {kind}, n_bytes long, n long, overlap int")
    seams = scratch.table(found, "seams")
    done = seams
    if not seams.where("n is null").isEmpty():
        # a chunk without a splice and all up to the next one that has one, or to the end, are one
        lead = seams.withColumn("open", F.expr("coalesce(lag(n is null) over (partition by row order by k), false)"))
        runs = lead.withColumn("g", F.expr("sum(if(open, 0, 1)) over (partition by row order by k)")).withColumn("lost", F.expr("bool_or(n is null) over (partition by row, g)"))
        runs = scratch.table(runs.select("row", "k", "id", "n_bytes", "n", "g", "lost"), "runs")
        again = windows.join(runs.where("lost").select("row", "k", "g"), ["row", "k"]).groupBy("row", "g").applyInArrow(_merged(tokenizer, chunk, overlaps), "row long, n long")
        named = seams.where("k = 0").select("row", "id", "n_bytes")
        sums = runs.where("not lost").select("row", "n").unionByName(again).groupBy("row").agg(F.sum("n").alias("n_tokens"))
        long = named.join(sums, "row").select("id", "n_bytes", "n_tokens")
    else:
        long = done.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select("id", "n_bytes", "n_tokens")
    return short.unionByName(long).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
