import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cdrforge.llm import queries, token_alignment as ta
from cdrforge.llm.token_alignment import token_alignment

SF = "/root/testdata/sf0.001"
BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def names() -> dict[str, int]:
    """Printable letters stand for their bytes, letters from 256 on for the others in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 173) and not 127 <= b <= 160]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


@pytest.fixture(scope="module")
def brute():
    """Links and counts one document at a time, with the libraries themselves."""
    a, b, letters = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), names()
    a.encode_special_tokens = True

    def groups(text):
        if not text:
            return []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids[1])]
        if any(b"".join(r) != (" " + text).encode() for r in raw):
            return []
        ends = [dict(zip(np.cumsum([len(x) for x in r]).tolist(), range(1, len(r) + 1), strict=True)) for r in raw]
        out, at = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0][cut], ends[1][cut]
            out.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
            at = to
        return out

    def table(docs):
        cut = [(i, groups(t)) for i, t in docs]
        links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for _, gs in cut]
        count = Counter(p for c in links for p in c)
        top = Counter()
        for (x, _), n in count.items():
            top[x] = max(top[x], n)
        rows = []
        for (i, gs), c in zip(cut, links, strict=True):
            text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
            best = sum(n for p, n in c.items() if count[p] == top[p[0]])
            rows.append((i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), sha256(text.encode()).hexdigest() if gs else ""))
        return rows

    return table


def check(out, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))
    assert order([tuple(r) for r in out.select(COLUMNS).collect()]) == order(want)


def test_alignment_of_the_table(spark, docs, brute):
    check(queries.op11_token_alignment(spark, SF), brute([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("hot", [0, 50, 100_000])
def test_odd_rows_however_many_pairs_are_looked_up(odd, brute, hot):
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    check(token_alignment(odd, BPE, PIECES, hot=hot), want)


def test_empty_tables_and_names(odd, none):
    out = token_alignment(none, BPE, PIECES)
    assert out.collect() == [] and out.columns == COLUMNS and {t for _, t in out.dtypes} == {"bigint", "string"}
    assert token_alignment(odd.withColumnRenamed("doc_id", "a.b"), BPE, PIECES, id_col="a.b").count() == odd.count()


HARD = ["a" * 5000, " " * 300 + "x", "\x00\x01 nul", "<s></s><|endoftext|><0x41>", "漢字かな" * 50, "\U0001f600" * 30, "é́ﬁ①", "tab\tand\nlines\r\n", "▁ mark", " ", "x", "ACGT" * 700]


def test_hard_texts(spark, brute):
    draw = random.Random(3)
    bits = ["the", "The", " ", "  ", "\n", "'s", "7", "é", "漢", "\U0001f600", ".", "▁", "ation", "<s>"]
    texts = HARD + ["".join(draw.choice(bits) for _ in range(draw.randrange(1, 80))) for _ in range(150)]
    docs = list(enumerate(texts))
    check(token_alignment(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), BPE, PIECES, hot=200), brute(docs))


def test_long_texts_in_parts(docs):
    """Cut anywhere it may be cut, a text has the same groups and links."""
    draw = random.Random(6)
    texts = [(r["text"] or "").encode() for r in docs.limit(40).collect()] + [t.encode() for t in HARD] + [None, b"", b"x  y z", b"no\tcut here\n at 'll all"]
    texts += [" ".join(draw.choice(["a", "'s", "don't", "7", "...", "é", "漢", "", "x" * 30, "▁", "\n"]) for _ in range(60)).encode() for _ in range(40)]
    plain = lambda rows: [(*r[:5], None if r[5] is None else (r[5].tolist(), r[6].tolist())) for r in rows]
    whole = plain(ta.align(texts, BPE, PIECES))
    assert plain(ta.align(texts, BPE, PIECES, most=1)) == whole == plain(ta.align(texts, BPE, PIECES, most=50))
    assert b"".join(ta.segments(texts[0], 10)) == texts[0] and len(list(ta.segments(texts[0], 10))) > 5


def test_large_groups_in_blocks(monkeypatch):
    """Distinct ids of a group too large to expand, and merged lists of pairs, give the same links."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 7, 300)
    first_a, first_b = np.array([0, 3, 250, 252, 400]), np.array([0, 5, 200, 201, 300])
    owner = np.array([0, 0, 1, 2])
    want = [x.tolist() for x in ta.distinct(ta.expand(a, b, first_a, first_b, owner, 7))]
    monkeypatch.setattr(ta, "_LINKS", 16)
    assert [x.tolist() for x in ta.distinct(ta.expand(a, b, first_a, first_b, owner, 7))] == want
    slow = Counter((o, x * 7 + y) for g, o in enumerate(owner.tolist()) for x in a[first_a[g] : first_a[g + 1]].tolist() for y in b[first_b[g] : first_b[g + 1]].tolist())
    assert [(o, p, n) for (o, p), n in sorted(slow.items())] == list(zip(*want, strict=True))


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000):
        ends = np.unique(np.append(rng.integers(1, n + 1, 50), n))
        words = ta.bits(ends, n)
        assert ta.select(words).tolist() == ends.tolist()
        assert ta.rank(words, np.arange(n + 1)).tolist() == [int((ends <= k).sum()) for k in range(n + 1)]
