import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cdrforge.llm import hashing, near_dup, queries, substring_dedup
from cdrforge.llm.line_dedup import drop_boilerplate
from cdrforge.llm.near_dup import near_duplicates
from cdrforge.llm.packing import pack
from cdrforge.llm.sharding import shard
from cdrforge.llm.sql import SQL
from cdrforge.llm.substring_dedup import range_ends, range_number, remove_repeats, sizes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def sets(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, percent=80):
    """Smallest id reachable, by comparing all pairs."""
    all_ = [(i, sets(t, size)) for i, t in rows if i is not None]
    up = {i: i for i, _ in all_}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(all_):
        for j, b in all_[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["", None, " a  b\tc\nd\x0be\x0cf\rg ", "é ü  x", "A a", "\x1c\x1d z"]
    w = hashing.words(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    assert list(np.diff(w.first)) == [len(x) for x in want]
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for ws in want for x in ws]
    same = defaultdict(set)
    for h, x in zip(w.hash, got, strict=True):
        same[x].add(int(h))
    assert all(len(v) == 1 for v in same.values()) and len({v for s in same.values() for v in s}) == len(same)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = components(rows, 5)
    got = near_duplicates(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in got}[7] == 29996
    assert near_duplicates(none).collect() == []


def test_large_groups_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):  # copies of one text, changed here and there, so that some are linked only through others
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 9)):
            w[k] = f"m{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(30)) + " common passage that all of these share with one another") for i in range(80)]
    want = components(rows, 2)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, list_block=24, set_block=2048)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert len(set(want.values())) > 81


def test_a_sketch_of_whole_sets_is_exact(spark):
    """Pairs just at the threshold, just below and just above, many of them: with a sketch that holds the sets none is missed."""
    rows, want = [], {}
    for t in range(400):
        common = [f"c{t}_{i}" for i in range(33 + t % 3)]  # 32 to 34 shingles of 2 words, of 40 to 42
        own = 4 + (t // 3) % 2
        for side in (0, 1):
            rows.append((2 * t + side, " ".join([*common, *(f"o{t}_{side}_{i}" for i in range(own))])))
    want = components(rows, 2)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, k=4096)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert 100 < len(set(want.values())) - 400 < 400


def test_only_candidates_are_shingled_past_a_full_filter(spark):
    texts = spark.createDataFrame([(k, f"some words of text {k % 50}") for k in range(2000)], "id long, text string")
    ids = texts.where("id % 7 = 0").select("id")
    for bits in (1 << 26, 1 << 10):
        got = near_dup.candidate_sets(texts, ids, 2, bits).collect()
        wanted = {r["id"]: r["payload"] for r in got if r["id"] % 7 == 0}
        assert len(wanted) == ids.count() and all(len(p) == 8 * 4 for p in wanted.values())
        assert bits > 1 << 20 or len(got) == len(wanted)


def test_columns_whose_names_hold_dots(odd):
    named = odd.withColumnsRenamed({"doc_id": "a.b", "text": "t.x"})
    got = near_duplicates(named, id_col="a.b", text_col="t.x").collect()
    assert {(r["a.b"], r["component_id"]) for r in got} == {(r["doc_id"], r["component_id"]) for r in near_duplicates(odd).collect()}
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert shard(named, path, id_col="a.b", text_col="t.x").count() == odd.count()
    assert pack(named, path, id_col="a.b", text_col="t.x").agg(F.sum("length")).first() == pack(odd, path).agg(F.sum("length")).first()


@pytest.mark.parametrize("copies", [700, 3000])
def test_a_class_of_a_third_of_all_rows(spark, copies):
    """Rows of a hot class, rows without words and rows without an id keep their verdicts."""
    rows = [(i, "the same five words and more" if i % 3 else f"text number {i} has words of its own") for i in range(copies)]
    rows += [(10_000 + i, "") for i in range(copies // 2)] + [(None, "the same five words and more")] * 3
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert r["component_id"] == (None if i is None else 1 if i < 10_000 and i % 3 else i)


def test_least_common_bounds_the_loss():
    from math import comb

    m = near_dup.least_common(48, 80, 1e-7)
    below = [sum(comb(48, k) * 0.8**k * 0.2 ** (48 - k) for k in range(x)) for x in (m, m + 1)]
    assert below[0] < 1e-7 <= below[1]


def brute_removal(rows, size):
    first, out = {}, []
    known = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in known:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, 1 << 62), 1 << 61 if i is None else i)
    for i, w in known:
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (1 << 61 if i is None else i):
                keep[k : k + size] = [False] * size
        out.append((i, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return sorted(out, key=repr)


def test_substrings_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [tuple(r) for r in remove_repeats(odd).collect()]
    assert sorted(got, key=repr) == brute_removal(rows, 13)
    assert remove_repeats(none).collect() == []
    kept = remove_repeats(odd, carry=["lang", "id", "payload"], layout=True).where("doc_id = 10").first()
    assert kept["kept"] == "x y z ▁ <|endoftext|>\n\nx" and (kept["lang"], kept["id"], bytes(kept["payload"])) == ("fr", "extra", b"x")


def test_substrings_over_many_batches(spark):
    rng = np.random.default_rng(2)
    shared = [" ".join(f"p{k}_{i}" for i in range(40)) for k in range(5)]
    rows = []
    for i in range(200):
        parts = [" ".join(f"d{i}_{rng.integers(0, 99)}" for _ in range(rng.integers(0, 30)))]
        if rng.random() < 0.6:
            parts.insert(rng.integers(0, 2), shared[rng.integers(0, 5)])
        rows.append((int(i * 7 % 200), "  ".join(parts)))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=2000, bucket_bytes=3000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_removal(rows, 13)


@pytest.mark.parametrize("lost", [None, 5])
def test_many_rows_without_an_id_or_of_one_id(spark, lost, monkeypatch):
    """A third of all rows: they are dealt over batches of their own, don't remove each other's words, and lose what stands in smaller ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("doc_id", F.expr(f"case when doc_id % 3 = 1 then {'null' if lost is None else lost} else doc_id end")).repartition(4)
    seen, told = [], substring_dedup.heavy_ids
    monkeypatch.setattr(substring_dedup, "heavy_ids", lambda *a: seen.append(told(*a)) or seen[-1])
    got = remove_repeats(docs, batch_bytes=40_000).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))

    rows = [(math.inf if r["doc_id"] is None else r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.collect()]
    first = {}
    for i, ws in rows:
        for k in range(len(ws) - 12):
            key = tuple(ws[k : k + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, ws in rows:
        gone = {k + x for k in range(len(ws) - 12) if first[tuple(ws[k : k + 13])] < i for x in range(13)}
        want.append((None if i == math.inf else i, len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and sum(w[2] > 0 for w in want) > 50
    assert len(seen[0]) == 1 and next(iter(seen[0].values())) > 2


def test_range_number(spark):
    bounds = [-5, 0, 3, 9, 100, 101]
    for b in ([], bounds[:1], bounds, list(range(-9, 100, 2))):
        got = range_number(spark.range(-10, 110), "id", b).collect()
        assert len(got) == 120 and all(r["batch"] == sum(x < r["id"] for x in b) for r in got)


def test_ranges_hold_about_the_same_bytes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i * 3), int(n)) for i, n in enumerate([*rng.integers(0, 3000, 3000), *[500_000] * 30, *rng.integers(0, 3000, 3000)])] + [(0, 100)] * 50
    df = spark.createDataFrame(rows, "id long, bytes long").repartition(5)
    ends = range_ends(df, 20)
    assert ends == sorted(set(ends)) and 10 < len(ends) < 20 and range_ends(df, 1) == []
    held = Counter()
    for r in range_number(df, "id", ends).collect():
        held[r["batch"]] += max(r["bytes"], 1 << 14)
    assert max(held.values()) < 2.5 * sum(held.values()) / 20


def test_sizes_follow_the_input():
    assert sizes(1 << 30, None, None) == (16 << 20, 8 << 20) and sizes(1 << 30, 5, 6) == (5, 6)
    for total in (10**12, 10**13, 10**14):
        batch, bucket = sizes(total, None, None)
        assert batch * bucket / total >= 500 and max(batch, bucket) <= 256 << 20


def test_lines_of_odd_rows(spark, odd, none):
    got = drop_boilerplate(odd, ratio=0.5)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    assert drop_boilerplate(none).collect() == []
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["text"] is None and by[4]["n_lines"] == 0 and by[6]["n_lines"] == 0
    assert by[10]["text"] == "x y z ▁ <|endoftext|>\n\nx" and by[10]["n_lines"] == 2 and by[10]["id"] == "extra"


@pytest.mark.parametrize("most", [0, 1000])
def test_boilerplate_goes_from_its_host_only(spark, most):
    rows = [(i, f" Menu \nown line {i}\n\nMenu\nall over" if i % 2 else f"own line {i}\nMenu", "a" if i % 2 else "b") for i in range(20)]
    rows += [(100 + i, f"text {i}", "b") for i in range(80)]
    got = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), ratio=0.5, broadcast_rows=most)
    for r in got.collect():
        if r["source"] == "a":
            assert r["text"] == f"own line {r['doc_id']}\n" and (r["n_lines"], r["n_removed"]) == (4, 3)
        else:
            assert r["n_removed"] == 0 and r["text"] == dict((x[0], x[1]) for x in rows)[r["doc_id"]]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_small_hosts_lose_the_lines_they_share(spark, n):
    rows = [(i, f"Menu\nown line {i}\nHome", "small") for i in range(n)] + [(100, "Menu\nalone", "other")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {100: ("Menu\nalone", 0)} | {i: (f"own line {i}", 2) if n > 1 else (t, 0) for i, t, h in rows if h == "small"}


def test_digests_are_of_the_kept_text(spark):
    rows = queries.op7_substring_dedup(spark, SF).limit(5).collect()
    kept = {r["doc_id"]: r["kept"] for r in remove_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert all(hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest() == r["kept_sha256"] for r in rows)


@pytest.mark.parametrize("percent", [80, 60])
def test_frequent_shingles_alone_make_no_lists(spark, monkeypatch, percent):
    """Texts of few words share many shingles: a text has few rows in lists if it is like no other; and neighbours in sketches lose no link."""
    rng, rows, seen, linked = np.random.default_rng(53), [], [], near_dup.block_links

    def spy(members, check, unsigned, scratch, per_key):
        seen.append((per_key, members.count()))
        return linked(members, check, unsigned, scratch, per_key)

    monkeypatch.setattr(near_dup, "block_links", spy)
    for k in range(1500):
        n = int(rng.integers(2, 90))
        ws = [f"w{x}" for x in rng.integers(0, 80, n)]
        rows.append((2 * k, " ".join(ws)))
        if k % 10 == 0:
            ws[int(rng.integers(n))] = "new"
            rows.append((2 * k + 1, " ".join(ws)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, percent=percent).collect()}
    sets = {i: frozenset(zip(ws := t.split(), ws[1:])) for i, t in rows}
    assert {i for i in sets if i % 2 and 100 * len(sets[i] & sets[i - 1]) >= percent * len(sets[i] | sets[i - 1])} <= {i for i in sets if got[i] != i and got[i] == got.get(i - 1)}
    if percent == 80:
        assert dict(seen)["list"] < 4 * len(rows), seen


def test_least_neighbours_bounds_the_loss():
    m = near_dup.least_neighbours(12, 80, 1e-3)
    rng = np.random.default_rng(59)
    common = rng.random((1_000_000, 12)) < 0.8
    n = (common[:, 1:] & common[:, :-1]).sum(1)
    assert (n < m).mean() < 1.1e-3 < (n < m + 1).mean()
