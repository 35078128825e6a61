import pytest
from pyspark.sql import functions as F

from cdrforge.functions import genes, sequences as s


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize(("call", "want"), [("TRBV20-1*05", "TRBV20-1"), ("IGKV1D-8*02,IGKV1-8*11,x", "IGKV1D-8,IGKV1-8,x"), ("no allele", "no allele"), ("A*b,B**1,C*2*", "A*b,B*,C*"), ("*01", "")])
def test_strip_alleles(spark, call, want):
    assert one(spark, genes.strip_alleles(C("c")), c=call) == want


@pytest.mark.parametrize(("call", "want"), [("TRBV9*02,TRBV5-1*01,TRBV9*01,TRBV5-1", ["TRBV5-1", "TRBV9"]), ("", []), (None, []), ("  ", []), ("A,,B", ["", "A", "B"]), ("A,", ["", "A"]), ("*01", [""]), ("B, A", [" A", "B"])])
def test_gene_calls(spark, call, want):
    assert one(spark, genes.gene_calls(C("c")), c=call) == want


def test_overlap(spark):
    assert one(spark, genes.genes_overlap(C("a"), C("b")), a=["A", "C"], b=["B", "C"]) and not one(spark, genes.genes_overlap(C("a"), C("b")), a=[], b=["B"])
    assert one(spark, genes.smallest_common(C("a"), C("b")), a=["A", "C", "D"], b=["C", "D"]) == "C"
    assert one(spark, genes.smallest_common(C("a"), C("b")), a=["A"], b=["B"]) is None


@pytest.mark.parametrize(("a", "b", "want"), [("GATTACA", "GATTACA", 0), ("GATTACA", "GACTAGA", 2), ("CCG", "TTA", 3), ("TGTGC", "TG", 0), ("", "AC", 0), ("t", "T", 1), ("", "", 0), ("ACGTACGT", "TCG", 1)])
def test_distance(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(s.hamming_distance(C("a"), C("b")), s.hamming_bytes(C("a"), C("b"), 2)).first()) == (want, want)


@pytest.mark.parametrize(("a", "b"), [("\x00a\x7f" * 9, "\x01b\xff" * 9), ("é" * 20, "è" * 20), ("ACGTACGTACGTAC", "ACGTACG"), ("A" * 63, "a" * 63)])
def test_distance_over_bytes(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = a.encode(), b.encode()
    assert df.select(s.hamming_bytes(C("a"), C("b"), 9)).first()[0] == sum(p != q for p, q in zip(x, y)) if len(x) == len(y) or "\x00" not in a else True


@pytest.mark.parametrize(("text", "n", "want"), [("TGCGATTACGATC", 3, ["TGCGA", "TTAC", "GATC"]), ("abcdefghijk", 4, ["abc", "def", "ghi", "jk"]), ("TGA", 5, ["T", "G", "A", "", ""]), ("", 1, [""]), ("whole", 1, ["whole"])])
def test_chunks(spark, text, n, want):
    assert one(spark, s.chunks(C("t"), C("n")), t=text, n=n) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0"), (999, "999"), (4096, "4,096"), (65536, "65,536"), (10**9, "1,000,000,000"), (-50000, "-50,000")])
def test_digits(spark, n, want):
    assert one(spark, s.group_digits(C("n")), n=n) == want


def test_left_pad(spark):
    assert one(spark, s.left_pad(C("t"), 8), t="41") == "      41" and one(spark, s.left_pad(C("t"), 8), t="10,000,000") == "10,000,000"


def test_lengths(spark):
    assert one(spark, s.reported_length(C("a"), C("b")), a="3", b="38") == 36
    for bad in (None, "", "x", "1.5"):
        with pytest.raises(Exception, match="not an integer coordinate"):
            one(spark, s.reported_length(C("a"), C("b")), a=bad, b="38")
    assert one(spark, s.max_distance(C("n"), 0.29) < 29, n=100)  # doubles, not decimals


def test_dots(spark):
    assert one(spark, s.dot_count(C("t"), C("n")), t="a..b.c", n=4) == 2
    assert one(spark, s.without_gaps(C("t")), t="..a...c.") == "ac"


TAIL = "|F|V-REGION|1..9|9 nt|1| | | | |9+0=9| | |"


LONG = ">X1|IGHV1*01|more|Mus spretus" + TAIL
ODD = [(LONG, "IGHV1*01|more_Mus_spretus"), (f">X1|TR|Homo{TAIL}", None), (f">X|IGH|IGK|Homo{TAIL}", "IGK"), (f">X1|IGHV1*01|TRBV2|Homo{TAIL}", "TRBV2"), (f">|IGHV1|x{TAIL}", "IGHV1"), (f"X1|IGHV1|x{TAIL}", None), (f">IGHV1|x|y{TAIL}", None)]


@pytest.mark.parametrize(("line", "want"), ODD)
def test_overlong_and_odd_headers(spark, line, want):
    assert one(spark, s.imgt_gene(C("t")), t=line) == want


@pytest.mark.parametrize(("line", "want"), [(f">M99641|IGHV1-18*01|Homo sapiens{TAIL}", "IGHV1-18*01"), (f">X1|TRBV1*01|Mus musculus{TAIL}", "TRBV1*01"), (f">X1|IGHV1*01|mus  SPRETUS{TAIL}", "IGHV1*01_Mus_spretus"), (">X1|IGHV1*01|Homo sapiens|F|", None), ("acgt", None)])
def test_imgt_headers(spark, line, want):
    assert one(spark, s.imgt_gene(C("t")), t=line) == want
