"""Counts over the words and lines of whole Arrow text columns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from cdrforge.llm.hashing import U, Words, mix, powers, windows, words


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, UPPER, LETTER, DIGIT = _class(b"#*$%&|<>"), _class(range(65, 91)), _class([*range(65, 91), *range(97, 123)]), _class(range(48, 58))
_INNER = _class(range(0x80, 0xC0))  # bytes that don't begin a code point
_NEWLINE, _BANG, _PIPE, _COMMA = (_class(c) for c in (b"\n", b"!", b"|", b".,;:"))


class Lines(NamedTuple):
    start: np.ndarray  # bytes
    end: np.ndarray
    first: np.ndarray  # index of each text's first line, one more than texts
    words: np.ndarray  # of each line
    first_word: np.ndarray
    again: np.ndarray  # it has a word and equals an earlier line of its text


def counter(mask: np.ndarray):
    """Counts of ``mask`` between two positions."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return lambda a, b: total[b] - total[a]


def lines(w: Words) -> Lines:
    """Lines between line feeds; a text of n line feeds has n + 1 of them, an empty one too."""
    breaks = np.flatnonzero(_NEWLINE[w.data])
    start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, w.offsets[1:]]), kind="stable")
    per = np.searchsorted(breaks, w.offsets)
    first = per + np.arange(len(per))
    first_word = np.searchsorted(w.start, start)
    n = np.searchsorted(w.start, end) - first_word
    h = np.zeros(len(start), np.uint64)
    if len(w.data):
        solid = ~_NEWLINE[w.data]
        long = end - start
        at = np.cumsum(long) - long
        full = long > 0
        if full.any():
            inside = np.arange(int(long.sum())) - np.repeat(at, long)
            h[full] = np.add.reduceat((w.data[solid].astype(np.uint64) + U(1)) * powers(int(long.max()))[inside], at[full])
        h = mix(h ^ long.astype(np.uint64))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), bool)
    same[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return Lines(start, end, first, n, first_word, same & (n > 0))


def owners(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def repeated_words(w: Words, size: int = 3) -> np.ndarray:
    """Of each text: words in ``size``-word windows that it holds twice or more."""
    g, doc = windows(w.hash, size), owners(w)
    if not len(g):
        return np.zeros(len(w.first) - 1, np.int64)
    at = np.flatnonzero(doc[: len(g)] == doc[size - 1 :])
    order = at[np.lexsort((g[at], doc[at]))]
    same = (g[order[1:]] == g[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(doc), bool)
    for k in range(size):
        cover[order[twice] + k] = True
    return np.bincount(doc[cover], minlength=len(w.first) - 1)


class Stats(NamedTuple):
    w: Words
    lines: Lines
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def stats(column: pa.Array) -> Stats:
    w = words(column)
    ls = lines(w)
    a, b = w.offsets[:-1], w.offsets[1:]
    points = counter(~_INNER[w.data])
    return Stats(w, ls, np.diff(w.first), _sum(points(w.start, w.end), w.first), counter(SYMBOL[w.data])(a, b), counter(ls.again)(ls.first[:-1], ls.first[1:]), repeated_words(w))


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _shares(w: Words, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> list[np.ndarray]:
    """Of spans from byte a to b and from word wa to wb."""
    n, letters = np.maximum(wb - wa, 1), np.maximum(counter(LETTER[w.data])(a, b), 1)
    size = np.maximum(b - a, 1)
    last = w.data[w.end - 1] if len(w.end) else w.data[:0]
    near = np.zeros(len(w.hash), bool)
    near[1:] = w.hash[1:] == w.hash[:-1]
    return [
        counter(SYMBOL[w.data])(a, b) / size,
        counter(_BANG[w.data])(a, b) / size,
        counter(_PIPE[w.data])(a, b) / n,
        counter(UPPER[w.data])(a, b) / letters,
        counter(DIGIT[w.data])(a, b) / size,
        counter(near)(wa, wb) / n,
        counter(SYMBOL[last])(wa, wb) / n,
    ]


def line_features(s: Stats) -> np.ndarray:
    """A row for each line: 1, size, shares of odd characters and repeated words, and repetition."""
    w, ls = s.w, s.lines
    return np.stack([np.ones(len(ls.start)), np.log1p(ls.words) / 3, *_shares(w, ls.start, ls.end, ls.first_word, ls.first_word + ls.words), ls.again], 1)


N_LINE_FEATURES = 10


def document_features(s: Stats) -> np.ndarray:
    """A row of 16 statistics for each text; none depends on its language, source or id."""
    w, ls = s.w, s.lines
    a, b, wa, wb = w.offsets[:-1], w.offsets[1:], w.first[:-1], w.first[1:]
    n, k = np.maximum(s.n_words, 1), np.diff(ls.first)
    distinct = np.zeros(len(n))
    if len(w.hash):
        doc = owners(w)
        order = np.lexsort((w.hash, doc))
        new = np.ones(len(order), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=len(n))
    return np.stack([
        np.log1p(s.n_words), np.log1p(k), *_shares(w, a, b, wa, wb), s.n_repeat_words / n, s.n_dup_lines / k, s.word_chars / n, np.log1p(s.n_words / k),
        counter(_COMMA[w.data])(a, b) / n, distinct / n, counter(w.data >= 128)(a, b) / np.maximum(b - a, 1),
    ], 1)


N_DOCUMENT_FEATURES = 16
