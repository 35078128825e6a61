import math
from collections import Counter, defaultdict
from zlib import crc32

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cdrforge.llm import packing, queries, sentence_pieces, sharding
from cdrforge.llm.packing import pack
from cdrforge.llm.sharding import place, shard

SF = "/root/testdata/sf0.001"
BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokens():
    t = Tokenizer.from_file(BPE)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, docs, tokens, size):
    """Every id lies in one piece, windows are gapless and full but for powers of two."""
    want = Counter((i, tuple(tokens(t))) for i, t in docs)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, pieces in by_doc.items():
        copies = [list(t) for (j, t), n in want.items() if j == i for _ in range(n)]
        for total in {len(c) for c in copies}:
            same = [c for c in copies if len(c) == total]
            starts = Counter((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_tokens"] == total)
            assert sum(n * x for (_, n, _), x in starts.items()) == total * len(same)
            assert all(any(crc32(np.array(c[s : s + n], "<u4").tobytes()) == crc for c in same) for s, n, crc in starts)
            covered = Counter(k for (s, n, _), x in starts.items() for k in list(range(s, s + n)) * x)
            assert all(covered[k] == len(same) for k in range(total))
    assert set(by_doc) == {i for i, _ in want}
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == size or at & (at - 1) == 0
    assert sum(sum(n for _, n in w) not in (size,) for w in by_window.values()) <= size.bit_length()


def test_packing_of_the_table(spark, docs, tokens):
    rows = queries.op9_packing(spark, SF).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokens, 1024)


def test_packing_of_odd_rows_over_many_partitions(odd, none, tokens):
    rows = pack(odd.repartition(7), BPE, size=64, open_windows=2, merge=2).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], tokens, 64)
    assert all(crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert pack(none, BPE).collect() == [] and pack(odd.where("false"), BPE).collect() == []


def test_packing_of_long_runs_of_white_space(spark, tokens):
    docs = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 1_200_000), (3, "x\t" * 9)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), BPE, size=1 << 20).collect()
    for i, text in docs:
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] == i])
        assert ids.tolist() == tokens(text) and {r["doc_tokens"] for r in rows if r["doc_id"] == i} == {len(ids)}


def test_special_tokens_in_texts_are_those_of_the_library(spark, tmp_path):
    t = Tokenizer.from_file(BPE)
    end, rng = "<|endoftext|>", np.random.default_rng(3)
    parts = [end, " ", "  ", "\n", "a", "b.", "<|", "endoftext", "|>", "é", "7", "'s"]
    texts = ["a <|endoftext|> b", end, end + end, " " * 1_200_000 + end, *("".join(rng.choice(parts, 12)) for _ in range(2000))]
    for text in texts:
        assert packing.encode(text, BPE).tolist() == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = True
    for text in texts[:3]:
        assert packing.encode(text, BPE, special=False).tolist() == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = False
    spark.createDataFrame(list(enumerate(texts[:3])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts[:3])}
    cut = lambda r: crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for got in (queries.op9_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")):
        rows = got.collect()
        assert sum(r["length"] for r in rows) == sum(map(len, want.values())) and all(r["ids_crc32"] == cut(r) for r in rows)


def test_best_fit_and_the_fullest():
    p = packing.Packer(10, 2, 0)
    ids = lambda n: np.zeros(n, "<u4")
    p.add("a", 0, ids(6), 6)
    p.add("b", 0, ids(7), 7)
    p.add("c", 0, ids(3), 3)  # fits b's window exactly
    assert [(x[0], len(x[2]), x[4], x[5]) for x in p.out] == [("b", 7, 0, 0), ("c", 3, 0, 7)]
    p.add("d", 0, ids(8), 8)
    p.add("e", 0, ids(5), 5)  # fits nowhere: cut to fill the fullest, d's
    assert [(x[0], x[1], len(x[2]), x[4], x[5]) for x in p.out[2:]] == [("d", 0, 8, 1, 0), ("e", 0, 2, 1, 8)]
    assert [r for r, _ in p.open] == [1]


def check_shards(rows, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return Counter({s: sum(r["size"] for r in rows if r["shard"] == s) for s in slots})


def test_shards_of_the_table(spark, docs):
    rows = queries.op10_sharding(spark, "/root/testdata/sf0.01").collect()
    rows_of = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sizes = check_shards(rows, [(r["doc_id"], r["text"]) for r in rows_of])
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) <= 1.1 * min(counts.values())
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_shards_of_odd_rows_and_of_a_large_group(spark, odd, none):
    check_shards(shard(odd, BPE).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert shard(none, BPE).collect() == [] and shard(odd.where("false"), BPE).collect() == []
    docs = [(i, "the same text for all of these " * 3 if i % 3 else f"own text {i} " * 9) for i in range(3000)]
    sizes = check_shards(shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), BPE).collect(), docs)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def packed_by_one(groups, shards=8):
    """Vector bin packing in one process: groups (bytes, tokens, rows), the largest share first; loads and where each went."""
    total = [sum(g[k] for g in groups) for k in range(3)]
    share = [[g[k] / total[k] for k in range(3)] for g in groups]
    left, where = [[1 / shards] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(groups)), key=lambda i: (-max(share[i]), i)):
        dots = [sum(a * b for a, b in zip(share[i], room, strict=True)) for room in left]
        where[i] = dots.index(max(dots))
        left[where[i]] = [a - b for a, b in zip(left[where[i]], share[i], strict=True)]
    return [[1 - x * shards for x in room] for room in left], where


def grouped(docs, tokens):
    groups = defaultdict(lambda: [0, 0, 0])
    for _, t in docs:
        for k, x in enumerate((len((t or "").encode()) + 1, len(tokens(t)) - 1, 1)):
            groups[t or ""][k] += x
    return groups


def test_shards_as_one_process_packs_them(spark, tokens):
    """Few groups: the same shards. A whole table: bytes, tokens and rows as even as one process makes them."""
    rng = np.random.default_rng(5)
    few = [(i, " ".join("word" * int(rng.integers(1, 5)) for _ in range(int(rng.integers(1, 60))))) for i in range(90)] + [(500, "")]
    got = {r["doc_id"]: r["shard"] for r in shard(spark.createDataFrame(few, "doc_id long, text string").repartition(3), BPE).collect()}
    order = {r["t"]: k for k, r in enumerate(spark.createDataFrame([(t,) for t in {t for _, t in few}], "t string").selectExpr("t", "xxhash64(t) h").orderBy("h").collect())}
    groups = grouped(few, tokens)
    names = sorted(groups, key=order.get)
    _, where = packed_by_one([groups[t] for t in names])
    assert got == {i: where[names.index(t)] for i, t in few}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    groups = grouped(docs, tokens)
    loads, _ = packed_by_one(list(groups.values()))
    shares, total = np.zeros((8, 3)), np.array(list(groups.values())).sum(0)
    text = dict(docs)
    for r in queries.op10_sharding(spark, "/root/testdata/sf0.01").collect():
        t = text[r["doc_id"]]
        shares[r["shard"]] += np.array([len(t.encode()) + 1, len(tokens(t)) - 1, 1]) / total
    assert (np.abs(8 * shares - 1).max(0) <= np.abs(np.array(loads)).max(0) + 0.03).all()


@pytest.mark.parametrize("most", [8, 40])
def test_bins_are_merged_until_few_are_left(spark, monkeypatch, most):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(["text", str(i), *["more"] * int(rng.integers(0, 40))])) for i in range(4000)]
    monkeypatch.setattr(sharding, "_BINS", most)
    monkeypatch.setattr(sharding, "_FAN", 2)
    calls, merge = [], sharding._merge
    monkeypatch.setattr(sharding, "_merge", lambda *a: calls.append(a) or merge(*a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # one partition a file
    try:
        rows = shard(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), BPE).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    sizes = check_shards(rows, docs)
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
    assert len(calls) == (2 if most == 8 else 0)  # 4 files, 2 partitions, 1


def test_the_highest_dot_product_wins():
    loads = np.array([[0.5, 0.0, 0.1], [0.1, 0.5, 0.1]])
    assert place(np.array([[0.2, 0.01, 0.01], [0.01, 0.9, 0.01]]), loads, np.ones(3)).tolist() == [1, 0]


def test_pieces_are_sampled_in_proportion():
    v = sentence_pieces.vocabulary(PIECES)
    by_raw = defaultdict(list)
    for i, r in enumerate(v.raw):
        if np.isfinite(v.score[i]) and not (len(r) == 1 and v.byte[r[0]] == i):
            by_raw[r].append(i)

    def cuts(b):
        if not b:
            yield (), 0.0
        for k in range(1, len(b) + 1):
            for i in by_raw.get(b[:k], ()):
                for rest, s in cuts(b[k:]):
                    yield (i, *rest), v.score[i] + s

    weight = {c: math.exp(s) for c, s in cuts(b" nation")}
    total, n = sum(weight.values()), 20000
    got = Counter(tuple(x.tolist()) for x in sentence_pieces.sample([b"nation"] * n, np.arange(n, dtype=np.uint64), v))
    assert set(got) <= set(weight)
    assert sum(abs(got[c] / n - w / total) for c, w in weight.items()) / 2 < 0.02


def test_pieces_give_back_every_text_and_do_not_depend_on_the_batch(docs):
    v = sentence_pieces.vocabulary(PIECES)
    odd = ["", " ", "  a  b ", "▁x▁", "é\x00\t\n", "\U0001f600\U0001f468\u200d\U0001f469", "x" * 9000, " " * 500]
    texts = [t.encode() for t in [*(r["text"] for r in docs.limit(40).collect()), *odd]]
    keys = np.arange(len(texts), dtype=np.uint64)
    got = sentence_pieces.sample(texts, keys, v)
    assert all(sentence_pieces.decode(x, v) == t for x, t in zip(got, texts, strict=True))
    for k in range(0, len(texts), 3):
        assert sentence_pieces.sample([texts[k]], keys[k : k + 1], v)[0].tolist() == got[k].tolist()
    assert any(a.tolist() != b.tolist() for a, b in zip(got, sentence_pieces.sample(texts, keys + np.uint64(1), v), strict=True))


def test_draws_do_not_depend_on_the_size_of_the_batch(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 40, 30_000)
    value = rng.random(int(sizes.sum())) / 40
    lead = np.cumsum(sizes) - sizes
    together = sentence_pieces.running(value, lead)
    for a, n in zip(lead[::500], sizes[::500], strict=True):
        alone = sentence_pieces.running(value[a : a + n], np.zeros(1, int))
        assert (alone == together[a : a + n]).all() and np.allclose(alone, np.cumsum(value[a : a + n]))
    # a megabyte in one call, in halves and in small runs
    v, words = sentence_pieces.vocabulary(PIECES), "international understanding of the reproducible segmentation nationwide".split()
    texts = [" ".join(rng.choice(words, 40)).encode() for _ in range(2000)]
    keys = np.arange(len(texts), dtype=np.uint64)
    whole = sentence_pieces.sample(texts, keys, v)
    for step in (1000, 37):
        parts = [x for k in range(0, len(texts), step) for x in sentence_pieces.sample(texts[k : k + step], keys[k : k + step], v)]
        assert all((x == y).all() if len(x) == len(y) else False for x, y in zip(whole, parts, strict=True))


def test_pieces_of_odd_rows(spark, odd, none):
    got = sentence_pieces.encode(odd, PIECES)
    rows = got.collect()
    assert len(rows) == odd.count() and all(r["lossless"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (4, 5))
    back = Counter((r["doc_id"], r["text"]) for r in sentence_pieces.decode_rows(got, PIECES).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert sentence_pieces.encode(none, PIECES).collect() == []
    assert all(r["lossless"] for r in queries.op6_sentencepiece(spark, SF).collect())


def test_a_piece_that_runs_into_a_space_is_refused(monkeypatch):
    class Model:
        def __init__(self, model_file):
            pass

        get_piece_size = lambda self: 1
        id_to_piece = lambda self, i: "a▁b"
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="runs from another character into a space"):
        sentence_pieces.vocabulary("made up")
