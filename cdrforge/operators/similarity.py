"""Exact Hamming similarity self-join of nodes.

Two nodes are joined if their reported lengths are equal, they share a V and a J
gene, and they differ in at most ratio * length positions. With d differences
allowed, one of d + 1 chunks is equal in both, so candidates come from an
equi-join on (length, V, J, chunk). A pair meets in several of these keys; the
smallest common V and J and the first equal chunk emit it, so no shuffle is
needed to make pairs distinct.

A key that many nodes share, such as a conserved start, says little, and its pairs
grow with its square. There the rule is applied again: outside the shared chunk the
two differ in at most d places, so that rest is cut into d + 1 pieces and the key made
longer by one of them, and so on while a key stays hot. What is hot even then is
dealt into blocks. Where a sample shows that longer keys would leave many of the pairs,
as in a family, the key's rows are compared in tiles at once. Hot keys come from a sketch of frequent items, one small row per
task, and are counted exactly in a second pass; whatever is taken to be hot, the
pairs are the same.

Sequences travel as longs of seven bytes, or of 31 places where those of a reported length hold
A, C, G and T only and have that length; which chunks two of the latter share is read off the longs,
others carry chunks as hashes. Genes travel as numbers of a
dictionary in the order of their names: a row holds the bits of the node's genes that
come before its key's gene, so that a pair has met in its smallest common one if the
AND of both is zero. A candidate costs some operations on longs in generated code.
Sequences of one reported length are laid out for the longest of them, and lengths of
like size are joined together, so that long ones do not slow down the others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cdrforge.functions.sequences import PACKED, PLACES, chunk, chunk_places, chunks, hamming_distance, max_distance, packed_words, unlike_bytes, unlike_places, words
from cdrforge.operators import tiles

#: Longs or chunks of a row in a class of lengths; beyond the last a row holds arrays, which generated code cannot compare.
_CLASSES = (8, 24)
#: Names and lengths that the driver sees at most; with more, genes are compared in arrays and all lengths laid out alike.
_NAMES = 4096
#: Hot keys that are broadcast at most, the items that the sketch tracks, of how many nodes it sees one, and how often a hot key is cut again.
_HOT_KEYS, _TRACKED, _EVERY, LEVELS = 10_000, 1 << 16, 16, 3
_BITS = 62
#: Rows of a key that are cut again to see what share of its pairs is left, the share from which it goes to tiles, a tile's rows to those of a block, and the rows of a block to those that tiles need.
_SAMPLE, _LEFT, _TILE, _FEW = 256, 0.25, 2, 4


def _joinable(nodes: DataFrame, ratio: float) -> DataFrame:
    """nodes with ``n``, the number of chunks; those whose limit is negative join nothing and are left out."""
    limit = max_distance(F.col("cdr_length"), ratio)
    return nodes.where(limit >= 0).withColumn("n", (F.floor(limit) + 1).cast("int"))


def pigeonhole_chunks(nodes: DataFrame, ratio: float = 0.1) -> DataFrame:
    """nodes that can join others, with ``chunks``."""
    return _joinable(nodes, ratio).withColumn("chunks", chunks(F.col("cdr3"), F.col("n"))).drop("n")


def block_sizes(nodes: DataFrame) -> DataFrame:
    """Members and pairs of each (cdr_length, v, j) block: where the join's work lies."""
    keys = nodes.select("cdr_length", F.explode("v_call").alias("v"), "j_call").select("cdr_length", "v", F.explode("j_call").alias("j"))
    return keys.groupBy("cdr_length", "v", "j").agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))


class Layout(NamedTuple):
    """What a row of a class of lengths looks like."""

    size: int  # longs of the longest sequence
    n: int  # chunks
    lengths: list[int] | None  # reported lengths of the class; None: all
    genes: dict[str, list[str]] | None  # names of V and J genes in order; None: too many
    packed: bool = False  # whether a long holds 31 places

    @property
    def wide(self) -> bool:
        return max(self.size, self.n) > _CLASSES[-1]

    @property
    def masked(self) -> bool:
        """Whether shared chunks are read off the packed longs; beyond so many terms hashes are less code."""
        return self.packed and self.n * self.size <= _CLASSES[-1]

    @property
    def gene_words(self) -> int:
        return sum(-(-len(names) // _BITS) for names in self.genes.values()) if self.genes else 0


def layouts(nodes: DataFrame, ratio: float) -> list[Layout]:
    """One for each class of lengths that occurs. One small aggregate of names and lengths goes to the driver."""
    base = _joinable(nodes, ratio)

    def names(c: str) -> Column:
        return F.transform(c, lambda g: F.struct(F.lit(c).alias("kind"), g.alias("name"), F.lit(0).alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("packed")))

    fits = F.coalesce(F.col("cdr3").rlike(rf"\A[{PACKED}]*\z") & (F.octet_length("cdr3") == F.col("cdr_length")), F.lit(False))
    length = F.array(F.struct(F.lit("").alias("kind"), F.col("cdr_length").cast("string").alias("name"), F.octet_length("cdr3").alias("bytes"), "n", fits.alias("packed")))
    seen = base.select(F.inline(F.concat(names("v_call"), names("j_call"), length))).groupBy("kind", "name").agg(F.max("bytes").alias("bytes"), F.max("n").alias("n"), F.min("packed").alias("packed"))
    rows = seen.limit(_NAMES + 1).collect()
    if len(rows) > _NAMES:
        most, n = base.agg(F.max(F.octet_length("cdr3")), F.max("n")).first()
        return [Layout(-(-most // 7), n, None, None)]
    genes: dict[str, list[str]] | None = {c: sorted((r["name"] for r in rows if r["kind"] == c), key=str.encode) for c in ("v_call", "j_call")}
    of_class: dict[tuple[bool, int], list] = {}
    for r in rows:
        if not r["kind"]:
            size = -(-r["bytes"] // 7)
            kind = sum(max(size, r["n"]) > c for c in _CLASSES)
            of_class.setdefault((packed := r["packed"] and kind < len(_CLASSES), kind), []).append((max(1, -(-r["bytes"] // PLACES)) if packed else size, r["n"], int(r["name"])))
    out = [Layout(max(s for s, _, _ in c), max(n for _, n, _ in c), sorted(x for _, _, x in c), genes, packed) for (packed, _), c in sorted(of_class.items())]
    return [x._replace(genes=None) if x.gene_words > _CLASSES[-1] else x for x in out]


def _spread(name: str, values: list[Column], wide: bool) -> list[Column]:
    return [F.array(*values).alias(name)] if wide else [v.alias(f"{name}{i}") for i, v in enumerate(values)]


def _numbered(names: list[str], calls: str) -> Column:
    """The numbers of a node's genes."""
    if not names:
        return F.array().cast("array<int>")
    table = F.create_map(*(x for k, g in enumerate(names) for x in (F.lit(g), F.lit(k))))
    return F.transform(calls, lambda g: table[g])


def _before(ids: str, own: str, names: list[str]) -> list[Column]:
    """Longs with the bits of a node's genes that come before its own one in the row."""
    def word(k: int) -> Column:
        inside = lambda g: (g < F.col(own)) & (g >= _BITS * k) & (g < _BITS * (k + 1))
        bits = F.aggregate(ids, F.lit(0).cast("long"), lambda s, g: s.bitwiseOR(F.when(inside(g), F.call_function("shiftleft", F.lit(1).cast("long"), g - _BITS * k)).otherwise(F.lit(0).cast("long"))))
        return F.when(F.size(ids) > 1, bits).otherwise(F.lit(0).cast("long"))

    return [word(k) for k in range(-(-len(names) // _BITS))]


def _hashes(text: Column, n: int) -> list[Column]:
    """Of the pieces of a text; one that a shorter sequence has none of is null, and equal to nothing."""
    return [F.when(F.col("n") > i, F.xxhash64(chunk(text, F.col("n"), F.lit(i)))) for i in range(n)]


def _own(name: str, pos: str, x: Layout) -> Column:
    return F.get(name, F.col(pos)) if x.wide else F.coalesce(*(F.when(F.col(pos) == i, F.col(f"{name}{i}")) for i in range(x.n)))


def _first(name: str, a, b, x: Layout) -> Column:
    """The first place at which two rows' hashes are equal."""
    if x.wide:
        return F.array_position(F.zip_with(a(name), b(name), lambda p, q: p.eqNullSafe(q) & p.isNotNull()), True) - 1
    return F.coalesce(*(F.when(a(f"{name}{i}") == b(f"{name}{i}"), i) for i in range(x.n)))


def _keyed(nodes: DataFrame, ratio: float, key: str, x: Layout, by: Sequence[str], fresh: str | None, *others: str) -> DataFrame:
    """A row for each common thing that candidates can have: ``k``."""
    base = _joinable(nodes, ratio)
    if x.lengths is not None:
        base = base.where(F.col("cdr_length").isin(x.lengths))
    genes = x.genes or {}
    ids = {c: _numbered(genes[c], c) if x.genes else F.transform(c, lambda g: F.xxhash64(g)) for c in ("v_call", "j_call")}
    raw = F.col("cdr3").cast("binary")
    out = base.select(
        F.col(key).alias("key"), *by, *others, (F.col(fresh) if fresh else F.lit(True)).alias("fresh"), "cdr_length", "n", raw.alias("rest"), F.octet_length("cdr3").alias("bytes"),
        *_spread("w", (packed_words if x.packed else words)(F.col("cdr3"), x.size), x.wide), *_spread("h1_", _hashes(raw, x.n), x.wide), ids["v_call"].alias("vs"), ids["j_call"].alias("js"),
    )
    out = out.select("*", F.explode("vs").alias("v")).select("*", F.explode("js").alias("j"))
    if x.genes:
        bits = [*_before("vs", "v", genes["v_call"]), *_before("js", "j", genes["j_call"])]
        out = out.select(*(c for c in out.columns if c not in ("vs", "js")), *(b.alias(f"before{i}") for i, b in enumerate(bits)), F.explode(F.expr("sequence(0, n - 1)")).alias("p1"))
    else:
        out = out.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("p1"))
    return out.withColumn("k", F.xxhash64(*by, "cdr_length", "v", "j", "p1", _own("h1_", "p1", x)))


def _cut_again(rows: DataFrame, level: int, x: Layout) -> DataFrame:
    """Rows of hot keys with what the key leaves of their sequence, and a row for each piece of that: a longer ``k``."""
    n, at = F.col("n"), F.col(f"p{level - 1}")
    size, more = F.floor(F.octet_length("rest") / n).cast("int"), F.octet_length("rest") % n
    begin = at * size + F.least(at, more)
    rest = F.concat(F.substring("rest", F.lit(1), begin), F.substring("rest", begin + size + F.when(at < more, 1).otherwise(0) + 1, F.octet_length("rest")))
    out = rows.withColumn("rest", rest)
    out = out.select("*", *_spread(f"h{level}_", _hashes(F.col("rest"), x.n), x.wide)).select("*", F.explode(F.expr("sequence(0, n - 1)")).alias(f"p{level}"))
    return out.withColumn("k", F.xxhash64("k", f"p{level}", _own(f"h{level}_", f"p{level}", x)))


def hot_keys(rows: DataFrame, block: int) -> DataFrame | None:
    """k, c (its rows), odd (of these, rows whose string has not the reported length) of keys that more than ``block`` rows share; None if there is none.

    The sketch sees the nodes of one in ``_EVERY`` hashes where a block holds many, and
    keeps a bounded number of items; a key it has lost is joined like any other.
    """
    every = min(_EVERY, max(1, block // 64))
    seen = rows.where(F.expr(f"pmod(xxhash64(key, 13), {every}) = 0")) if every > 1 else rows
    top = seen.agg(F.expr(f"approx_top_k(k, {_HOT_KEYS}, {_TRACKED})").alias("top")).first()["top"] or []
    often = [(r["item"],) for r in top if r["item"] is not None and r["count"] * every > block * 0.7]
    if not often:
        return None
    some = rows.sparkSession.createDataFrame(often, "k long")
    counted = rows.join(F.broadcast(some), "k", "left_semi").groupBy("k").agg(F.count("*").alias("c"), F.count_if(F.col("bytes") != F.col("cdr_length")).alias("odd"))
    found = counted.where(F.col("c") > block).collect()  # as many as were broadcast
    return rows.sparkSession.createDataFrame(found, counted.schema) if found else None


def alike_keys(rows: DataFrame, level: int, x: Layout) -> DataFrame:
    """k of the keys of whose pairs many would be left if they were made longer: judged by a few of the ``c`` rows of each, and for the plan only."""
    few = rows.where(F.expr(f"pmod(xxhash64(key, 29), cast(ceil(c / {_SAMPLE}) as long)) = 0")).withColumn("of", F.col("k"))
    cut = _cut_again(few, level + 1, x).groupBy("of", "k", f"p{level + 1}").agg(F.count("*").alias("c"))
    of = cut.groupBy("of", f"p{level + 1}").agg(F.sum("c").alias("c"), F.sum(F.expr("c * (c - 1)")).alias("left"))
    return of.groupBy("of").agg(F.sum("left").alias("left"), F.max(F.expr("c * (c - 1)")).alias("all")).where(F.col("left") >= _LEFT * F.col("all")).select(F.col("of").alias("k"))


def _tile_edges(rows: DataFrame, keys: DataFrame, level: int, x: Layout, by: Sequence[str]) -> DataFrame:
    """Pairs of the rows of ``keys`` (k, nb), each where it is to be emitted, as by ``_compared``."""
    longs, same = [f"w{i}" for i in range(x.size)], ["v", "j", "cdr_length", *(f"p{i}" for i in range(1, level + 1))]
    bits, hashes = [f"before{i}" for i in range(x.gene_words)], [f"h{i}_{c}" for i in range(1, level + 1) for c in range(x.n)]
    rows = rows.join(F.broadcast(keys), "k").withColumn("t", F.expr("pmod(xxhash64(key, 7), nb)")).withColumn("o", F.explode(F.expr("sequence(0L, nb - 1)")))
    rows = rows.select(
        "k", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1).alias("side"), (F.col("n") - 1).alias("most"),
        "key", *by, "fresh", *same, *longs, *bits, *(F.coalesce(h, F.lit(0)).alias(h) for h in hashes), "n",
    )
    kind = rows.select(*by, "cdr_length", F.col("key").alias("a"), F.col("key").alias("b")).schema

    def met(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
        value = {c: table.column(c).to_numpy() for c in ("fresh", "n", *same, *bits, *hashes)} | {c: tiles.codes(table.column(c)) for c in by}

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            good = value["fresh"][a] | value["fresh"][b]
            for c in (*same, *by):
                good &= value[c][a] == value[c][b]
            for c in bits:
                good &= (value[c][a] & value[c][b]) == 0
            a, b = a[good], b[good]
            for i in range(1, level + 1):
                equal = np.stack([(value[h][a] == value[h][b]) & (value["n"][a] > k) for k, h in enumerate(f"h{i}_{c}" for c in range(x.n))], 1)
                first = equal.argmax(1) == value[f"p{i}"][a]
                a, b = a[first & equal.any(1)], b[first & equal.any(1)]
            one, other = table.select([*by, "cdr_length", "key"]).take(a), table.select(["key"]).take(b)
            columns = [*one.columns, *other.columns]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in columns], names=[*by, "cdr_length", "a", "b"])

        return pairs

    found = tiles.compare(rows, longs, "most", met, kind, x.packed)
    return found.select(*by, "cdr_length", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _unlike_places(a, b, x: Layout) -> list[Column]:
    return unlike_places(*([side(f"w{i}") for i in range(x.size)] for side in (a, b)))


def _first_chunk(a, b, ratio: float, x: Layout) -> Column:
    """The first chunk that two rows of packed sequences of one length share, from a table of the chunks' places: little code, which the JVM compiles."""
    least, unequal = x.lengths[0], _unlike_places(a, b, x)
    cuts = {length: int(ratio * length // 1) + 1 for length in range(least, x.lengths[-1] + 1)}
    tables = [F.expr(f"array({', '.join(f'{chunk_places(length, n, i, k) if i < n else -1}L' for length, n in cuts.items() for i in range(x.n))})") for k in range(x.size)]
    at = (a("cdr_length") - least) * x.n

    def shared(i: int) -> Column:
        return functools.reduce(Column.bitwiseOR, (z.bitwiseAND(F.get(t, at + i)) for z, t in zip(unequal, tables, strict=True))) == 0

    return F.coalesce(*(F.when(shared(i), i) for i in range(x.n)))


def unlike(a, b, x: Layout) -> Column:
    """In how many bytes the sequences of two rows differ; beyond the shorter one's end each byte differs from none, and doesn't count."""
    if x.packed:
        return functools.reduce(Column.__add__, (F.bit_count(z) for z in _unlike_places(a, b, x)), F.lit(0))
    if x.wide:
        found = F.aggregate(F.zip_with(a("w"), b("w"), lambda p, q: unlike_bytes([p], [q])), F.lit(0), lambda s, p: s + p)
    else:
        found = unlike_bytes(*([side(f"w{i}") for i in range(x.size)] for side in (a, b)))
    return found - F.abs(a("bytes") - b("bytes"))


def _compared(left: DataFrame, right: DataFrame, level: int, ratio: float, x: Layout, by: Sequence[str]) -> DataFrame:
    """Pairs of one level's rows with equal ``k``, each where it is to be emitted. ``left`` holds fresh rows only."""
    # not renamed: the optimizer tries all mixtures of old and new names in what it knows of k
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in "ab")
    # sorted and merged: the size of the files says nothing of a side's rows, which are many to a node
    pairs = left.alias("a").hint("merge").join(right.alias("b"), (a("k") == b("k")) & functools.reduce(Column.__and__, (a(c).eqNullSafe(b(c)) for c in by), F.lit(True)))
    # what k stands for, in a form that is no join key: sides are dealt and sorted by one long
    unequal = [a(c).bitwiseXOR(b(c)) for c in ("v", "j", "cdr_length", *(f"p{i}" for i in range(1, level + 1)))]
    rules = [
        functools.reduce(Column.bitwiseOR, unequal) == 0, (a("key") < b("key")) | ~b("fresh") & (a("key") != b("key")), unlike(a, b, x) <= max_distance(a("cdr_length"), ratio),
        *((_first_chunk(a, b, ratio, x) if x.masked and i == 1 else _first(f"h{i}_", a, b, x)) == a(f"p{i}") for i in range(1, level + 1)),
    ]
    if not x.genes:
        least = lambda g: (F.size(a(f"{g}s")) == 1) | (F.size(b(f"{g}s")) == 1) | (a(g) == F.array_min(F.array_intersect(a(f"{g}s"), b(f"{g}s"))))
        rules += [least("v"), least("j")]
    elif x.gene_words:
        both = [a(f"before{i}").bitwiseAND(b(f"before{i}")) for i in range(x.gene_words)]
        rules.append(functools.reduce(Column.bitwiseOR, both) == 0)
    pairs = pairs.where(functools.reduce(Column.__and__, rules))  # at once: each call would have the plan analysed anew
    return pairs.select(*(a(c).alias(c) for c in by), a("cdr_length").alias("cdr_length"), F.least(a("key"), b("key")).alias("a"), F.greatest(a("key"), b("key")).alias("b"))


def _class_edges(nodes: DataFrame, ratio: float, key: str, block: int, x: Layout, by: Sequence[str], fresh: str | None) -> list[DataFrame]:
    rows, out = _keyed(nodes, ratio, key, x, by, fresh), []
    meet = lambda left, right, level: out.append(_compared(left.where("fresh").drop("rest"), right.drop("rest"), level, ratio, x, by))
    for level in range(1, LEVELS + 1):
        often = hot_keys(rows, max(1, block // _FEW))
        if often is not None and not x.wide and x.genes:
            even = often.where("odd = 0")
            alike = alike_keys(rows.join(F.broadcast(even.select("k", "c")), "k"), level, x).collect() if level < LEVELS else even.select("k").collect()  # of the keys that the driver knows
            if alike:
                chosen = rows.sparkSession.createDataFrame(alike, "k long")
                out.append(_tile_edges(rows, even.join(chosen, "k").select("k", F.ceil(F.col("c") / (_TILE * block)).alias("nb")), level, x, by))
                rows, often = rows.join(F.broadcast(chosen), "k", "left_anti"), often.join(chosen, "k", "left_anti")
        often = often and often.where(F.col("c") > block)
        if often is None or often.isEmpty():
            meet(rows, rows, level)
            return out
        cold = rows.join(F.broadcast(often.select("k")), "k", "left_anti")
        meet(cold, cold, level)
        # strings that have not the reported length do not line up with others outside a chunk
        deep = F.col("odd") == 0 if level < LEVELS else F.lit(False)
        flat = rows.join(F.broadcast(often.where(~deep).select("k", F.ceil(F.col("c") / block).cast("int").alias("nb"))), "k")
        if level == LEVELS or not often.where(~deep).isEmpty():
            left = flat.withColumn("of", F.explode(F.expr("sequence(0, nb - 1)")))
            right = flat.withColumn("of", F.expr("cast(pmod(xxhash64(key, 7), nb) as int)"))
            meet(*(side.withColumn("k", F.xxhash64("k", "of")).drop("of", "nb") for side in (left, right)), level)
        if level == LEVELS or often.where(deep).isEmpty():
            return out
        rows = _cut_again(rows.join(F.broadcast(often.where(deep).select("k")), "k"), level + 1, x)
    return out


def edges(nodes: DataFrame, ratio: float = 0.1, key: str = "cdr3", block: int = 4096, by: Sequence[str] = (), fresh: str | None = None) -> DataFrame:
    """(cdr_length, a, b) with a < b, each pair once; a and b are the nodes' ``key``, which must be unique.

    ``by``: columns in which both must be equal (null is a value like others), such as a
    donor; they come first in the result, and ``key`` need be unique within them only.
    ``fresh``: a boolean column; only pairs with at least one fresh node are looked for.
    ``block``: rows from which a join key counts as hot.
    """
    found = [e for x in layouts(nodes, ratio) for e in _class_edges(nodes, ratio, key, block, x, list(by), fresh)]
    if not found:
        kind = nodes.schema[key].dataType
        return nodes.select(*by, "cdr_length", F.col(key).cast(kind).alias("a"), F.col(key).alias("b")).limit(0)
    return functools.reduce(DataFrame.unionByName, found)


def edges_by_definition(nodes: DataFrame, ratio: float = 0.1, by: Sequence[str] = (), block: int = 65536) -> DataFrame:
    """The same pairs straight from the definition: all nodes of a length with a V and a J gene in common are compared, for tests and diagnosis.

    Quadratic in each (length, V, J) block but for what ``tiles.Balls`` tells apart; no chunk and
    no key of the join is used. A block is dealt into tiles of about ``block`` rows, and each two tiles meet once,
    so no task holds a block. A pair comes from the block of its smallest common genes. Short
    ASCII sequences are compared as bytes, which is the same distance; any others by characters.
    """
    plain = F.coalesce(F.col("cdr3").rlike(rf"\A[\x01-\x7f]{{0,{7 * _CLASSES[-1]}}}\z"), F.lit(False))
    limit = F.floor(max_distance(F.col("cdr_length"), ratio)).cast("int")
    rows = nodes.select(*by, "cdr_length", "cdr3", F.col("v_call").alias("vs"), F.col("j_call").alias("js"), plain.alias("plain"), limit.alias("most")).where("most >= 0")
    rows = rows.select("*", F.explode("vs").alias("v")).select("*", F.explode("js").alias("j")).where("v is not null and j is not null").withColumn("k", F.xxhash64(*by, "cdr_length", "v", "j"))
    sizes = rows.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"), F.count_if(~F.col("plain")).alias("odd"), F.count("*").alias("c")).where("c > 1").drop("c")
    dealt = rows.join(sizes, "k").withColumn("t", F.expr("cast(pmod(xxhash64(cdr3, 5), nb) as int)"))
    out = _definition_tiles(dealt.where("plain"), by)
    if nodes.where(~plain).isEmpty():
        return out
    rows = dealt.where("odd > 0")
    left = rows.withColumn("of", F.explode(F.expr("sequence(t, nb - 1)"))).withColumn("cell", F.xxhash64("k", "t", "of"))
    right = rows.withColumn("of", F.explode(F.expr("sequence(0, t)"))).withColumn("cell", F.xxhash64("k", "of", "t"))
    a, b = (lambda c, s=s: F.col(f"{s}.{c}") for s in "ab")
    least = lambda g: (a(g) == b(g)) & ((F.size(a(f"{g}s")) == 1) | (F.size(b(f"{g}s")) == 1) | (a(g) == F.array_min(F.array_intersect(a(f"{g}s"), b(f"{g}s")))))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        rules = [
            (a("cdr_length") == b("cdr_length")) & (a("t") == b("of")) & (a("of") == b("t")), (a("cdr3") < b("cdr3")) | (a("t") < b("t")),
            hamming_distance(a("cdr3"), b("cdr3")) <= max_distance(a("cdr_length"), ratio), *(a(c).eqNullSafe(b(c)) for c in by), least("v"), least("j"),
        ]
        pairs = left.alias("a").hint("merge").join(right.alias("b"), a("cell") == b("cell")).where(functools.reduce(Column.__and__, rules))
        return pairs.select(*(a(c).alias(c) for c in by), a("cdr_length").alias("cdr_length"), F.least(a("cdr3"), b("cdr3")).alias("a"), F.greatest(a("cdr3"), b("cdr3")).alias("b"))

    return out.unionByName(met(left.where("not plain"), right)).unionByName(met(left.where("plain"), right.where("not plain")))


def _definition_tiles(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of the rows of each ``k``, dealt into tiles ``t`` of ``nb``, that differ in at most ``most`` bytes."""
    genes = [F.expr(f"filter({g}s, x -> x < {g})").alias(f"before_{g}") for g in "vj"]  # a pair with one of these in common comes from another block
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "k", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), F.when(F.col("t") == F.col("o"), 2).when(F.col("t") < F.col("o"), 0).otherwise(1).alias("side"), "most",
        *by, "cdr_length", "v", "j", "cdr3", *genes,
    )
    kind = rows.select(*by, "cdr_length", F.col("cdr3").alias("a"), F.col("cdr3").alias("b")).schema

    def in_bits(lists: pa.ListArray) -> list[np.ndarray]:
        """Each row's list as bits, of 64 names each."""
        names, has, out = tiles.codes(pa.chunked_array([lists.flatten()])), pc.list_parent_indices(lists).to_numpy(), []
        for low in range(0, int(names.max(initial=-1)) + 1, 64):
            bits, some = np.zeros(len(lists), np.uint64), (names >= low) & (names < low + 64)
            np.bitwise_or.at(bits, has[some], np.uint64(1) << (names[some] - low).astype(np.uint64))
            out.append(bits)
        return out

    def met(table: pa.Table) -> Callable[[np.ndarray, np.ndarray], pa.RecordBatch]:
        same = [tiles.codes(table.column(c)) for c in ("cdr_length", "v", "j", *by)]
        before = [bits for g in "vj" for bits in in_bits(pa.concat_arrays(table.column(f"before_{g}").chunks))]
        order = pc.rank(table.column("cdr3")).to_numpy()

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            good = np.ones(len(a), bool)
            for c in same:
                good &= c[a] == c[b]
            for bits in before:
                good &= (bits[a] & bits[b]) == 0
            a, b = a[good], b[good]
            turned = order[a] > order[b]
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            of = lambda c, at: pa.concat_arrays(table.column(c).take(pa.array(at)).chunks or [pa.array([], table.schema.field(c).type)])
            return pa.RecordBatch.from_arrays([*(of(c, a) for c in (*by, "cdr_length")), of("cdr3", a), of("cdr3", b)], names=[*by, "cdr_length", "a", "b"])

        return pairs

    return tiles.compare(rows, "cdr3", "most", met, kind)
