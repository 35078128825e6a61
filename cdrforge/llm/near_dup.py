"""MinHash near-duplicates: bottom-k sketches of one hash function.

1. Texts with equal shingle sets fall into one class; the smallest id stands for it.
2. A class's sketch is the k smallest hashes of its set. Each two neighbours in it
   are a key: where both are common to two classes and adjacent in the union's
   sketch, they are neighbours in both. A frequent shingle alone makes no key, so
   texts that share such ones only do not meet, however many there are. Of the keys
   that two classes or more have, the rarest go into inverted lists: a pair with the
   similarity asked for shares at least m keys, so it meets in one of the r - m + 1
   rarest of its r repeated ones (prefix filter). m bounds a miss below ``loss`` for
   a pair just at the threshold, here and in step 3 together. Below 75 per cent,
   where common values need not be neighbours, single values are keys. Of lists with
   the same members one is kept.
3. Pairs within a list pass if the sketch of their union holds m common values.
   The components of these pairs are the candidates.
4. Within a candidate component full sets are compared, and true links give the
   final components.

A list or component that is too large for one task is dealt into blocks. Each
block also gets a few common pivots, so a large group of copies joins up in work
linear in its size; then only members outside the group's main component are
compared with all blocks. No pair is skipped unless both ends are already in one
component, so no link between components is lost, and no step emits all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cdrforge.llm.classes import join_classes
from cdrforge.llm.hashing import mix, pieces, windows, words
from cdrforge.operators.components import connected_components
from cdrforge.storage import Scratch
from cdrforge.workers import tidy

_SLAB = 4096


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's set of word shingles as sorted 64-bit hashes; fewer words than ``size`` count as one shingle."""
    w = words(column, lower=True)
    g = windows(w.hash, size)
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield windows(mix(w.hash[a:b], 3), int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _sketches(size: int, k: int) -> Callable:
    kind = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                n, key, low = [], [], []
                for s in shingle_sets(batch.column("text"), size):
                    n.append(len(s))
                    key.append((mix(s, 1).sum(), mix(s, 2).sum()) if len(s) else (None, None))
                    low.append(s[:k].view(np.int64))
                ka, kb = (pa.array([None if x[c] is None else int(x[c].view(np.int64)) for x in key], pa.int64()) for c in (0, 1))
                sketch = pa.ListArray.from_arrays(np.cumsum([0, *map(len, low)]).astype(np.int32), np.concatenate(low) if low else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), ka, kb, sketch], schema=kind)

    return tidy(run)


def _sets(size: int, bits: np.ndarray | None) -> Callable:
    """Shingle sets of the texts whose ids the filter lets through, or of all."""
    kind = pa.schema([("id", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hit = np.ones(whole.num_rows, bool)
            for k in range(_PROBES if bits is not None else 0):
                at = whole.column(f"p{k}").to_numpy()
                hit &= (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for batch in pieces(whole.filter(pa.array(hit)), "text") if hit.any() else ():
                sets = [s.tobytes() for s in shingle_sets(batch.column("text"), size)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], schema=kind)

    return tidy(run)


_PROBES, _MOST_BITS = 3, 1 << 26


def probes(size: int) -> list:
    return [F.expr(f"pmod(xxhash64(id, {k + 17}), {size}L)").alias(f"p{k}") for k in range(_PROBES)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``id``, of 8 MB at most: what it lets through by chance costs time only."""
    size = max(1 << 12, min(_MOST_BITS, 1 << (16 * max(1, ids.count())).bit_length()))
    at = ids.select(F.explode(F.array(*probes(size))).alias("p"))
    rows = at.groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def candidate_sets(texts: DataFrame, ids: DataFrame, shingle: int, most_bits: int = _MOST_BITS) -> DataFrame:
    """id and payload (shingle set) of the rows of ``texts`` (id, text) whose id is in ``ids`` (unique), and of some others.

    Up to ``most_bits`` / 16 ids a Bloom filter picks them where they are read. A filter
    of more ids would let most others through: then texts and ids are joined first.
    """
    kind = "id long, payload binary"
    if 16 * ids.count() > most_bits:
        return texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets(shingle, None), kind)
    bits = id_filter(ids)
    return texts.select("id", "text", *probes(len(bits) << 6)).mapInArrow(_sets(shingle, bits), kind)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of the block."""
    n = len(sets)
    flat = np.concatenate(sets)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    use = shared[at]
    row, col = row[use], rank[at[use]]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), _SLAB):
        part = (col >= lo) & (col < lo + _SLAB)
        a = np.zeros((n, min(_SLAB, int(shared.sum()) - lo)), np.float32)
        a[row[part], col[part] - lo] = 1
        out += a @ a.T
    return out


def sketch_pairs(k: int, least: int, percent: int) -> Callable:
    """Passes pairs whose union sketch holds ``least`` common values, or for sets smaller than that, as many as the similarity asks for."""

    def need(s: int) -> int:
        return min(least, -(-percent * s // 100))

    def check(sets: list[np.ndarray]) -> tuple[np.ndarray, Callable[[int, int], bool]]:
        size = np.array([need(len(s)) for s in sets])

        def exact(i: int, j: int) -> bool:
            _, times = np.unique(np.concatenate([sets[i], sets[j]]), return_counts=True)
            return int((times[:k] == 2).sum()) >= max(size[i], size[j])

        if len(sets) == 2:
            return ~np.eye(2, dtype=bool), exact
        return overlaps(sets) >= np.maximum(size[:, None], size[None, :]), exact

    return check


def jaccard_pairs(percent: int) -> Callable:
    def check(sets: list[np.ndarray]) -> tuple[np.ndarray, None]:
        size = np.array([len(s) for s in sets], np.float64)
        common = overlaps(sets).astype(np.float64)
        return 100 * common >= percent * (size[:, None] + size[None, :] - common), None

    return check


def forest(near: np.ndarray, exact: Callable[[int, int], bool] | None, label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join up what ``near`` (and ``exact``, where given) joins, labels being joined already: at most n - 1 of them."""
    _, group = np.unique(label, return_inverse=True)
    near = near & (group[:, None] != group[None, :])
    left = np.ones(len(label), bool)
    while left.any():
        first = int(np.argmax(left))
        todo = list(np.flatnonzero(group == group[first]))
        left[todo] = False
        while todo:
            i = int(todo.pop())
            for j in np.flatnonzero(near[i] & left):
                if left[j] and (exact is None or exact(i, int(j))):
                    yield i, int(j)
                    more = np.flatnonzero(group == group[j])
                    left[more] = False
                    todo += list(more)


def _linker(check: Callable, unsigned: str) -> Callable:
    """For rows (key, x, y, id, label, payload) sorted by key, x, y: links within each run."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(ids: np.ndarray, label: np.ndarray, payload: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if len(ids) > 1 and len(np.unique(label)) > 1:
            near, exact = check(payload)
            for i, j in forest(near, exact, label):
                yield int(ids[i]), int(ids[j])

    def unpack(batch: pa.RecordBatch) -> list[np.ndarray]:
        column = batch.column("payload")
        if pa.types.is_binary(column.type):
            return [np.frombuffer(x, unsigned) for x in column.to_pylist()]
        values, cut = column.values.to_numpy(zero_copy_only=False).astype(np.int32).view(unsigned), column.offsets.to_numpy()
        return [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids, labels, payload = [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y")])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
            i, lab, pay = batch.column("id").to_numpy(), batch.column("label").to_numpy(), unpack(batch)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(keys[:, a])
                if now != held:
                    if len(ids) > 1 or ids and len(ids[0]) > 1:
                        out += links(np.concatenate(ids), np.concatenate(labels), payload)
                    held, ids, labels, payload = now, [], [], []
                ids.append(i[a:b])
                labels.append(lab[a:b])
                payload += pay[a:b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kind)
        if ids and (out := list(links(np.concatenate(ids), np.concatenate(labels), payload))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=kind)

    return tidy(run)


def block_links(members: DataFrame, check: Callable, unsigned: str, scratch: Scratch, per_key: str) -> DataFrame:
    """Links that join up all pairs of a key's members which pass ``check``.

    ``members``: key, id, nb (blocks its key is dealt into, by the key's weight),
    payload. Every pair of a key is compared unless its ends are joined already.
    """
    run = _linker(check, unsigned)

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "x", "y", "id", "label", "payload")
        return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long")

    members = members.withColumn("x", F.when(F.col("nb") > 1, F.expr("pmod(xxhash64(id, 7), nb)")).otherwise(0))
    own = members.withColumn("label", F.col("id")).withColumn("y", F.lit(0))
    pivots = own.where("nb > 1 and pmod(xxhash64(id, 11), nb * 16) = 0").withColumn("to", F.explode(F.expr("sequence(0L, nb - 1)"))).where("to <> x").withColumn("x", F.col("to")).drop("to")
    first = scratch.table(linked(own.unionByName(pivots)), f"{per_key}-links")
    large = members.where("nb > 1").drop("payload")
    if large.isEmpty():
        return first
    label = connected_components(first, "labels")
    marked = large.join(label, large["id"] == label["node"], "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
    marked = scratch.table(marked, f"{per_key}-labels")
    main = marked.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("c"), F.count("*").alias("parts"))
    main = main.where("parts > 1").select("key", F.col("m.label").alias("main"), (F.col("c") - F.col("m.c")).alias("rest"), "c")
    mixed = marked.join(main, "key").withColumn("outside", F.col("label") != F.col("main")).withColumn("nr", F.expr("greatest(1L, cast(ceil(nb * rest / c) as long))"))
    mixed = scratch.table(mixed.withColumn("r", F.expr("pmod(xxhash64(id, 13), nr)")), f"{per_key}-mixed")
    if mixed.isEmpty():
        return first
    # a task is (block of outsiders y, block of the main part x) or, with x below 0, two blocks of outsiders
    inner = mixed.where("not outside").withColumn("y", F.explode(F.expr("sequence(0L, nr - 1)")))
    outer = mixed.where("outside").withColumn("y", F.col("r")).withColumn("x", F.explode(F.expr("sequence(0L, nb - 1)")))
    among = mixed.where("outside").withColumn("o", F.explode(F.expr("sequence(0L, nr - 1)"))).withColumn("x", -1 - F.least("r", "o")).withColumn("y", F.greatest("r", "o"))
    cols = ["key", "x", "y", "id", "label"]
    tasks = inner.select(cols).unionByName(outer.select(cols)).unionByName(among.select(cols))
    second = linked(tasks.join(members.where("nb > 1").select("key", "id", "payload"), ["key", "id"]))
    return first.unionByName(scratch.table(second, f"{per_key}-late"))


def least_common(k: int, percent: int, loss: float) -> int:
    """The most common values that a pair at the threshold has in the sketch of its union, but for a chance below ``loss``."""
    from math import exp, lgamma, log, log1p

    t, below, m = percent / 100, 0.0, 0
    chance = lambda m: exp(lgamma(k + 1) - lgamma(m + 1) - lgamma(k - m + 1) + m * log(t) + (k - m) * log1p(-t)) if t < 1 else float(m == k)
    while m < k and below + chance(m) < loss:
        below += chance(m)
        m += 1
    return max(1, m)


def least_neighbours(k: int, percent: int, loss: float) -> int:
    """The most neighbours of which both are common that a pair at the threshold has in the sketch of its union, but for a chance below ``loss``."""
    t = percent / 100
    apart, common = np.zeros(k), np.zeros(k)  # by the number of such neighbours, and by whether the last value is common
    apart[0], common[0] = 1 - t, t
    for _ in range(k - 1):
        apart, common = (apart + common) * (1 - t), apart * t + np.concatenate([[0], common[:-1] * t])
    return max(1, int(((apart + common).cumsum() < loss).sum()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 48, loss: float = 1e-7, list_block: int = 512, set_block: int = 16384, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept and, if asked for, text_hash (xxhash64 of the text).

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    ``shingle``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; a text
    of fewer words is one shingle). ``component_id`` is the smallest id that
    links reach, ``kept`` says that it is the row's own.

    A null or blank text has no shingles and is linked with nothing; so is a row
    with a null id (its component is null, it is kept). Rows of one id and equal
    texts count as one document; with different texts each has its own verdict,
    which ``text_hash`` assigns. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    least = least_common(k, percent, loss / 2)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = scratch.table(base.withColumn("h", F.xxhash64("text")).mapInArrow(_sketches(shingle, k), "id long, h long, n long, ka long, kb long, sketch array<long>"), "sketches")
    classes = rows.where("ka is not null and id is not null").groupBy("ka", "kb").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    classes = scratch.table(classes, "sizes")
    reps = rows.join(classes.select("ka", "kb", F.col("rep").alias("id")), ["ka", "kb", "id"], "left_semi").dropDuplicates(["id", "ka", "kb"])
    reps = scratch.table(reps.select("id", "n", "sketch"), "classes")

    if percent >= 75:  # of u values of a union, with at most a quarter not common, two neighbours are
        keys = F.expr("transform(slice(sketch, 1, greatest(size(sketch) - 1, 0)), (v, i) -> xxhash64(v, sketch[i + 1]))")
        need = F.expr(f"cast(greatest(1, least({least_neighbours(k, percent, loss / 2)}, ceil({2 * percent - 100} * n / 100 - 1))) as int)")
    else:
        keys, need = F.col("sketch"), F.expr(f"cast(least({least}, ceil({percent} * n / 100)) as int)")
    values = reps.select("id", F.explode(keys).alias("key"))
    often = values.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    lists = values.join(often, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("l"))
    lists = lists.join(reps.select("id", "n"), "id")
    lists = lists.withColumn("need", need).where("size(l) >= need")
    lists = lists.select("id", F.explode(F.expr("slice(l, 1, size(l) - need + 1)")).alias("e")).select(F.col("e.key").alias("key"), "id")
    lists = scratch.table(lists, "lists")
    # a pair or group meets in many lists: of those with the same members one is kept, and none of a single member
    marks = [F.bit_xor(F.xxhash64(*seed, "id")).alias(f"s{i}") for i, seed in enumerate(((), (F.lit(1),)))]
    same = lists.groupBy("key").agg(F.count("*").alias("c"), *marks).where("c > 1").groupBy("c", "s0", "s1").agg(F.min("key").alias("key"))
    kept = lists.join(same.select("key", F.expr(f"cast(ceil(c / {list_block}) as long)").alias("nb")), "key")
    kept = kept.groupBy("id").agg(F.collect_list(F.struct("key", "nb")).alias("l"))  # of a sketch's length at most
    members = kept.join(reps.select("id", F.expr("transform(sketch, v -> cast(shiftright(v, 32) as int))").alias("payload")), "id")
    members = members.select("id", "payload", F.explode("l").alias("e")).select("e.key", "id", "e.nb", "payload")
    at = scratch.write(members, "members")
    close = block_links(scratch.read(at, members), sketch_pairs(k, least, percent), "uint32", scratch, "list")
    scratch.drop(at)
    comp = connected_components(close, "candidates")
    comp = comp.union(comp.select(F.col("component").alias("node"), "component").distinct())
    sized = comp.join(reps.select(F.col("id").alias("node"), "n"), "node")
    weight = sized.groupBy(F.col("component").alias("ka")).agg(F.lit(0).alias("kb"), F.count("*").alias("w"), F.expr(f"cast(ceil(sum(greatest(n, 64)) / {set_block}) as long)").alias("nb"))
    keyed = comp.select(F.col("node").alias("id"), F.col("component").alias("ka"), F.lit(0).alias("kb"))
    cand = join_classes(keyed, scratch.table(weight, "weights"), F.col("id"))
    cand = scratch.table(cand.select("id", F.col("ka").alias("key"), "nb"), "candidates")
    full = candidate_sets(base, cand.select("id"), shingle)
    at = scratch.write(full, "sets")
    true = block_links(scratch.read(at, full).join(cand, "id"), jaccard_pairs(percent), "uint64", scratch, "set")
    scratch.drop(at)
    label = connected_components(true, "near")
    named = classes.join(label, classes["rep"] == label["node"], "left").select("ka", "kb", "w", F.coalesce("component", "rep").alias("c"))
    out = join_classes(rows.drop("sketch"), scratch.table(named, "named"), F.coalesce("id", "h"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")))
    text_hash = [F.col("h").alias("text_hash")] if digest else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept"), *text_hash)
