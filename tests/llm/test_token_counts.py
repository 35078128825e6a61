import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cdrforge.llm import queries, token_counts as tc
from cdrforge.llm.packing import encode
from cdrforge.llm.token_counts import token_counts

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SMALL = {"chunk": 64, "overlap": 16, "widest": 32}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def check(rows, docs, library):
    want = sorted((i is None, i or 0, len((t or "").encode()), library(t)) for i, t in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows)


def test_counts_of_the_table(spark, docs, library):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(queries.op12_token_counts(spark, SF).collect(), pairs, library)
    check(token_counts(docs, BPE, **SMALL).collect(), pairs, library)


def test_odd_rows(odd, none, library):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(token_counts(odd, BPE).collect(), pairs, library)
    check(token_counts(odd.repartition(5), BPE, **SMALL).collect(), pairs, library)
    out = token_counts(none, BPE)
    assert out.collect() == [] and out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    named = odd.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "n_bytes")
    assert token_counts(named, BPE, id_col="a.b", text_col="n_bytes").columns[0] == "a.b"


#: Texts whose chunks disagree at first, or for long: runs without a certain boundary, added tokens over the cuts, odd spaces.
HARD = [
    "a" * 3000, " " * 3000, "x" * 700 + " y " + "z" * 900, "\n\n \t" * 500, "'" * 900 + "'re'll've" * 200, "<|endoftext|>" * 120, "ab<|endoftext|>cd " * 90, "<|endo" * 300,
    "1234567890" * 150 + "abc" * 200, "\U0001f600" * 400, "漢字かな。" * 300, "é" * 1000, "don't we'll " * 100 + "q" * 500, "　 " * 500, "á" * 600, "-=-" * 500 + "\r\n" * 300,
]


@pytest.mark.parametrize("size", [dict(chunk=64, overlap=16, widest=16), SMALL, dict(chunk=200, overlap=20, widest=150)])
def test_hard_texts(spark, library, size):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    check(token_counts(docs, BPE, **size).collect(), list(enumerate(HARD)), library)


def test_random_texts(spark, library):
    draw = random.Random(5)
    bits = ["a", "B", "'s", "'", " ", "  ", "\n", "7", ",", "é", "漢", "<|endoftext|>", " ", "ll", "\U0001f600", "ſ", "᠎", "\x1c"]
    texts = [(k, "".join(draw.choice(bits[: draw.choice([4, 9, 18])]) for _ in range(draw.randrange(20, 500)))) for k in range(300)]
    check(token_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), BPE, chunk=32, overlap=16, widest=16).collect(), texts, library)


def test_a_splice_is_stable():
    """Up to a stable place both sides together have what the whole has, whatever stands round it."""
    draw = random.Random(9)
    bits = ["a", "B", "'s", "'", " ", "  ", "\n", "7", ",", "é", "漢", " ", "ll", "re", "́", "᠎", "\x1c", "Ⅷ", "²"]
    seen = 0
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(12))
        for k in range(1, len(text)):
            if tc.stable(text[k - 1], text[k]):
                seen += 1
                assert [*encode(text[:k], BPE), *encode(text[k:], BPE)] == [*encode(text, BPE)], (text, k)
    assert seen > 5000


def test_overlaps_must_fit(docs):
    with pytest.raises(ValueError, match="overlaps"):
        token_counts(docs, BPE, overlap=4)
