"""Sequence functions: distances, chunks, padding, IMGT headers and gaps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F


def reported_length(start: Column, end: Column) -> Column:
    """CDR3 length from its coordinates; a missing or non-integer one is an error."""

    def whole(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.raise_error(F.concat(F.lit("not an integer coordinate: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int"))

    return whole(end) - whole(start) + 1


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing characters over the shorter length, by built-in functions."""
    unlike = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda z: z)
    return F.when((a == "") | (b == ""), 0).otherwise(F.size(unlike))


def words(sequence: Column, n: int) -> list[Column]:
    """The bytes of a sequence in ``n`` longs of seven each, filled up with zeros."""
    piece = lambda i: F.hex(F.substring(sequence.cast("binary"), 7 * i + 1, 7))
    return [F.conv(F.rpad(piece(i), 14, "0"), 16, 10).cast("long") for i in range(n)]


#: Letters that fit two bits each, and places in a long.
PACKED, PLACES = "ACGT", 31


def packed_words(sequence: Column, n: int) -> list[Column]:
    """A sequence of these letters in ``n`` longs of 31 places each, filled up with the first one."""
    digits = F.translate(sequence, PACKED, "0123")
    return [F.conv(F.rpad(F.substring(digits, PLACES * i + 1, PLACES), PLACES, "0"), 4, 10).cast("long") for i in range(n)]


def unlike_places(xs: list[Column], ys: list[Column]) -> list[Column]:
    """A bit for each place of packed longs that differs."""
    z = [x.bitwiseXOR(y) for x, y in zip(xs, ys, strict=True)]
    return [p.bitwiseOR(F.shiftrightunsigned(p, 1)).bitwiseAND(F.lit(0x1555555555555555)) for p in z]


def chunk_places(length: int, n: int, i: int, word: int) -> int:
    """The bits of ``chunk`` ``i`` of ``n`` of a sequence that lie in its packed long ``word``."""
    ends = [min(max(k * (length // n) + min(k, length % n), PLACES * word), PLACES * (word + 1)) for k in (i, i + 1)]
    low, high = ((1 << 2 * (PLACES * (word + 1) - e)) - 1 for e in ends)
    return low ^ high


_LOW, _HIGH = 0x7F7F7F7F7F7F7F, 0x80808080808080


def _unlike(x: Column, y: Column) -> Column:
    """The highest bit of each of seven bytes that differ: a byte's low bits carry into it unless all are alike."""
    z = x.bitwiseXOR(y)
    return (z.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(z).bitwiseAND(F.lit(_HIGH))


def unlike_bytes(xs: list[Column], ys: list[Column]) -> Column:
    """In how many bytes longs of seven differ; eight longs share one count, each with its bits in a place of its own."""
    marks = [F.shiftrightunsigned(_unlike(x, y), i % 8) if i % 8 else _unlike(x, y) for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    counts = [F.bit_count(functools.reduce(Column.bitwiseOR, marks[k : k + 8])) for k in range(0, len(marks), 8)]
    return functools.reduce(Column.__add__, counts) if counts else F.lit(0)


def hamming_bytes(a: Column, b: Column, n: int) -> Column:
    """The same distance over bytes, for sequences of at most 7 ``n`` of them: what joins with many pairs compute in generated code."""
    return unlike_bytes(words(a, n), words(b, n)) - F.abs(F.octet_length(a) - F.octet_length(b))


def max_distance(length: Column, ratio: float) -> Column:
    """As a double: decimals would round otherwise."""
    return F.lit(float(ratio)) * length.cast("double")


def chunk(sequence: Column, n: Column, i: Column) -> Column:
    """Piece ``i`` (from 0) of ``n`` contiguous pieces whose lengths differ by one at most, the longer ones first; empty ones where n exceeds the length."""
    size, more = F.floor(F.length(sequence) / n).cast("int"), F.length(sequence) % n.cast("int")
    return F.substring(sequence, i * size + F.least(i, more) + 1, size + F.when(i < more, 1).otherwise(0))


def chunks(sequence: Column, n: Column) -> Column:
    """All ``n`` pieces, in order."""
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: chunk(sequence, n, i))


def left_pad(text: Column, width: int) -> Column:
    """Spaces on the left of shorter texts; longer ones stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def group_digits(n: Column) -> Column:
    return F.format_number(n, 0)


#: In an IMGT header 14 bars follow the gene's name, and the species is the field after it.
_BARS_AFTER, _RECEPTOR, _ANTIBODY, _SPRETUS = 14, "TR", "IG", r"(?i)Mus\s+spretus"


def imgt_gene(header: Column) -> Column:
    """Gene name in an IMGT header line (with its ``>``); null for any other line.

    Of the fields that leave enough bars behind them the name begins in the last one
    that starts as a receptor's name, or else as an antibody's; it ends where exactly
    so many bars are left, which is that same field unless the header is overlong.
    """
    fields = F.split(header, r"\|", -1)
    last = F.size(fields) - (_BARS_AFTER + 1)

    def name(start: str) -> Column:
        able = F.slice(fields, 2, F.greatest(last, F.lit(0)))
        at = F.array_max(F.transform(able, lambda f, i: F.when(f.startswith(start) & ((i < last - 1) | (F.length(f) > len(start))), i)))
        return F.array_join(F.slice(fields, at + 2, last - at), "|")

    antibody = F.concat(name(_ANTIBODY), F.when(F.get(fields, last + 1).rlike(_SPRETUS), "_Mus_spretus").otherwise(""))
    return F.when(header.startswith(">"), F.coalesce(name(_RECEPTOR), antibody))


def without_gaps(sequence: Column) -> Column:
    return F.regexp_replace(sequence, r"\.+", "")


def dot_count(sequence: Column, end: Column) -> Column:
    """Gaps among the first ``end`` characters."""
    head = F.substring(sequence, F.lit(1), end)
    return F.length(head) - F.length(F.replace(head, F.lit(".")))
