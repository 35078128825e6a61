import itertools
import json
import logging
import re
import subprocess
import sys
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from cdrforge import cli, logs, plots
from cdrforge.operators import germline as op
from cdrforge.sinks import charts, ordered, reports
from cdrforge.sources import aligner, germline
from cdrforge.sources.airr import read_airr

DATA = Path(__file__).parent / "data"
HEAD = "v_call\tj_call\tcdr3\tcdr3_aa\tcdr3_start\tcdr3_end\n"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_by_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\tcdr3_end\tj_call\tcdr3\tcdr3_start\tv_call\tcdr3_aa\n?\t38\tJ1*01\tACGT\t3\tV2*01,V1*02\tCA\n?\t4\t\t\t1\t\t\n")
    got = read_airr(spark, str(tmp_path / "a.tsv")).orderBy("ord").drop("ord")
    assert rows(got) == [("ACGT", "CA", 36, ["V1", "V2"], ["J1"]), ("", "", 4, [], [])]


@pytest.mark.parametrize("name", HEAD.split())
def test_missing_column(spark, tmp_path, name):
    path = tmp_path / "a.tsv"
    path.write_text(HEAD.replace(name, "other"))
    with pytest.raises(ValueError, match=f"Column '{name}' missing from"):
        read_airr(spark, str(path))


def test_each_file_has_its_own_header(spark, tmp_path):
    """Other orders, names that occur twice, line ends, blank lines, files without a line; rows with fields missing or too many are dropped, a blank field is none missing."""
    (tmp_path / "a one.tsv").write_text("x\t" + HEAD + "1\tV1*01\tJ1\tAAAA\tK\t1\t4\nshort\tV1\n2\tV2\tJ1\tCC\tP\t1\t2\tlong\n3\tV3\t\tG\"G\tG\t1\t3\n\n4\tV4\t\t\t\t1\t1\n")
    (tmp_path / "b.tsv").write_text("\ncdr3\tcdr3_end\tcdr3_start\tj_call\tv_call\tcdr3_aa\tv_call\r\nTT\t2\t1\tJ2\tV2*01\tF\tV9\r\n")
    (tmp_path / "c.tsv").write_text("")
    (tmp_path / "d.tsv").write_text(HEAD)
    want = [("AAAA", "K", 4, ["V1"], ["J1"]), ('G"G', "G", 3, ["V3"], []), ("", "", 1, ["V4"], []), ("TT", "F", 2, ["V2"], ["J2"])]
    for path in (str(tmp_path), f"{tmp_path}/*.tsv"):
        assert rows(read_airr(spark, path).orderBy("ord").drop("ord")) == want
    (tmp_path / "e.tsv").write_text("v_call\tj_call\nV\tJ\n")
    with pytest.raises(ValueError, match="Column 'cdr3' missing from .*e.tsv"):
        read_airr(spark, str(tmp_path))
    with pytest.raises(ValueError, match="Column 'v_call' missing from"):
        read_airr(spark, f"{tmp_path}/c.tsv")


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError, match="Input file '/nowhere.tsv' does not exist."):
        read_airr(spark, "/nowhere.tsv")


def test_order_over_files(spark, tmp_path):
    for n in "ba":
        (tmp_path / f"{n}.tsv").write_text(HEAD + "".join(f"V\tJ\t{n}{k}\tC\t1\t2\n" for k in range(5)))
    got = read_airr(spark, f"{tmp_path}/*.tsv").repartition(4).orderBy("ord")
    assert [r["cdr3"] for r in got.collect()] == [f"{n}{k}" for n in "ab" for k in range(5)]


def test_fasta(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.fasta").write_text(">a > b|1\nAC\nGT\n>b\n\n>c\nTT")
    got = germline.fasta_records(spark, str(tmp_path))
    assert sorted(rows(got.select("header", "sequence"))) == [("a > b|1", "ACGT"), ("b", ""), ("c", "TT")]
    assert got.first()["file"].endswith("s/x.fasta")


def test_germline_records_know_their_species_and_locus(spark, tmp_path):
    for path, text in {"Homo_sapiens/IG/IGHD.fasta": ">A1|IGHD1*01|Homo sapiens|F|\nac.g\n", "Mus_musculus/TR/TRBV.fasta": ">B1|TRBV1*01|Mus musculus|F|\nt\n", "loose.fasta": ">c\na\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = germline.germline_records(spark, str(tmp_path)).drop("file").orderBy("header")
    assert rows(got) == [("Homo sapiens", "IGH", "D", "A1|IGHD1*01|Homo sapiens|F|", "ac.g"), ("Mus musculus", "TRB", "V", "B1|TRBV1*01|Mus musculus|F|", "t"), (None, None, None, "c", "a")]


def test_tables(spark, tmp_path):
    (tmp_path / "v").write_text("#names\nA1\t1\t78\t79\t111\t112\t162\t163\t171\t172\t279\tVK\t0\nIGHV1  1 75  76 99 100 150 151 174 175 288  VH  0\n")
    (tmp_path / "j").write_text("#names\n\nIGHJ1*01\t0       JH      17      1      \nIGHJ1P*01\t2       JH\n")
    (tmp_path / "d").write_text("#frames\nIGHD1-1*02     2\n")
    assert [(r["name"], r["cdr1_stop"], r["fwr3_stop"], r["chain"], r["frame"]) for r in germline.v_annotation(spark, str(tmp_path / "v")).collect()] == [("A1", 111, 279, "VK", "0"), ("IGHV1", 99, 288, "VH", "0")]
    assert rows(germline.j_auxiliary(spark, str(tmp_path / "j"))) == [("IGHJ1*01", 0, "JH", 17, 1), ("IGHJ1P*01", 2, "JH", None, None)]
    assert rows(germline.d_frames(spark, str(tmp_path / "d"))) == [("IGHD1-1*02", 2)]
    (tmp_path / "m.njs").write_text('{\n "dbname": "x",\n "number-of-sequences": 703\n}')
    assert germline.blast_metadata(spark, str(tmp_path / "m.njs")).first()["number-of-sequences"] == 703


def allele(label, kind, seq, locus="IGH", marks=()):
    return {"label": label, "sequence_type": kind, "coding_sequence": seq, "locus": locus, "v_gene_delineations": list(marks)}


@pytest.fixture(scope="module")
def sets(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sets")
    ends = dict(zip(["fwr1_start", "fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end", "cdr2_start", "cdr2_end", "fwr3_start", "fwr3_end"], [1, 3, 4, 5, 6, 7, 8, 9, 10, 99], strict=True))
    marks = [{"delineation_scheme": "IMGT", **ends}, {"delineation_scheme": "kabat", **ends}]
    one = {"germline_set_name": "N", "germline_set_ref": "R.1", "allele_descriptions": [allele("V1", "V", "ac..gtacgt.a", marks=marks), allele("J1", "J", "t.t"), allele("V2", "V", "a")]}
    two = {"germline_set_name": "M", "germline_set_ref": "R.2", "allele_descriptions": [allele("V3", "V", ".g.", "IGK")]}
    (folder / "a.json").write_text(json.dumps({"GermlineSet": [one, two]}, indent=1))
    (folder / "b.json").write_text(json.dumps({"GermlineSet": two}, indent=1))
    return germline.germline_sets(spark, f"{folder}/a.json {folder}/b.json")


def test_germline_sets(sets, tmp_path):
    a = op.alleles(sets)
    written = ordered.write_fasta(op.fasta(a), str(tmp_path / "db"))
    assert written == [f"{tmp_path}/db.V", f"{tmp_path}/db.J"]
    assert (tmp_path / "db.V").read_text() == ">V1\nacgtacgta\n>V2\na\n>V3\ng\n" and (tmp_path / "db.J").read_text() == ">J1\ntt\n"
    assert dict(rows(op.titles(a))) == {"V": " N R.1  M R.2", "J": " N R.1"}
    ordered.write_annotation(op.v_annotation(a), str(tmp_path / "out" / "v.txt"))
    assert (tmp_path / "out" / "v.txt").read_text() == "V1\t1\t2\t2\t3\t4\t5\t6\t7\t8\t96\tVH\t0\n"


def test_imgt_rewrite(spark):
    tail = "|F|V-REGION|1..9|9 nt|1| | | | |9+0=9| | |"
    lines = spark.createDataFrame([(f">M1|IGHV1*01|Homo sapiens{tail}",), ("ac...gt.",), (">odd.header",)], "value string")
    assert [r["value"] for r in op.rewrite_imgt(lines).collect()] == [">IGHV1*01", "acgt", ">oddheader"]


def test_aligner_runs_once_a_partition(spark, tmp_path):
    tool = tmp_path / "tool.sh"
    body = """while read -r h; do read -r s; printf '%s\\tX\\tIGHV1*01,IGHV2*02\\tIGHJ%d*01\\tACGT\\tC R\\t3\\t6\\n' "${h#>}" $(grep -c '>' "$q"); done < "$q" >> "$o"\n"""
    tool.write_text('#!/bin/sh\nwhile [ $# -gt 0 ]; do case $1 in -query) q=$2;; -out) o=$2;; esac; shift; done\nprintf "sequence_id\\td_call\\tv_call\\tj_call\\tcdr3\\tcdr3_aa\\tcdr3_start\\tcdr3_end\\n" > "$o"\n' + body)
    tool.chmod(0o755)
    df = spark.createDataFrame([(f"r{k}", "ACGT") for k in range(6)], "header string, sequence string").coalesce(1)
    lines = [r["value"] for r in aligner.align(df, str(tmp_path), "tool.sh").collect()]
    assert len(lines) == 7 and lines[0].startswith("sequence_id\td_call") and lines[1].startswith("r0\tX\t")
    got = aligner.aligned_reads(df, str(tmp_path), "tool.sh").orderBy("ord").drop("ord")
    assert rows(got) == [("ACGT", "C R", 4, ["IGHV1", "IGHV2"], ["IGHJ6"])] * 6
    two = aligner.aligned_reads(df.repartition(2), str(tmp_path), "tool.sh")  # a run for each partition, each with a header of its own
    assert two.count() == 6 and {r["j_call"][0] for r in two.collect()} <= {f"IGHJ{n}" for n in range(1, 6)}
    assert aligner.aligned_reads(df.where("false"), str(tmp_path), "tool.sh").collect() == []
    with pytest.raises(Exception, match="aligner not found"):
        aligner.align(df, str(tmp_path), "none").collect()
    tool.write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(Exception, match="exit status 3"):
        aligner.align(df, str(tmp_path), "tool.sh").collect()
    assert aligner.command("p", "q", "o", 3)[-2:] == ["-num_threads", "3"]


def test_usage_table(spark, tmp_path):
    df = spark.createDataFrame([("IGHV4/OR15-8", 5), ("IGHV1", 2), ("IGHV4-61", 9)], "v_gene string, reads long")
    ordered.write_usage(df, tmp_path / "x" / "u.tsv")
    assert (tmp_path / "x" / "u.tsv").read_bytes() == b"v_gene\treads\nIGHV1\t2\nIGHV4-61\t9\nIGHV4/OR15-8\t5\n"
    assert sorted(rows(germline.result_table(spark, str(tmp_path / "x" / "u.tsv"), germline.USAGE_SCHEMA))) == [("IGHV1", 2), ("IGHV4-61", 9), ("IGHV4/OR15-8", 5)]
    with pytest.raises(FileNotFoundError):
        germline.result_table(spark, str(tmp_path / "none.tsv"), germline.USAGE_SCHEMA)


def test_charts():
    svg = charts.columns("V Gene Usage Statistics", "V genes", "reads", [("IGHV1-18", 249), ("a<b&c\"d'", 719), ("z", 208)])
    assert svg.startswith("<svg") and svg.endswith("</svg>\n") and svg.count('<path class="bar"') == 3
    assert "a&lt;b&amp;c&quot;d&apos;" in svg and "a<b&c" not in svg and svg.index("a&lt;b") < svg.index("IGHV1-18")
    lying = charts.rows("Clonal Lineage Statistics", "value", [("number of clonal lineages", 623), ("largest", 103)])
    assert lying.count('<path class="bar"') == 2 and ">623<" in lying and lying.index("number of") < lying.index("largest")
    for chart in (lambda b: charts.columns("t", "x", "y", b), lambda b: charts.rows("t", "x", b)):
        with pytest.raises(ValueError, match="bars must not be empty."):
            chart([])
        flat = chart([("a", 0), ("b", 0)])
        assert flat.count('<path class="bar"') == 2 and "nan" not in flat and "inf" not in flat
    for image in (svg, lying, flat):
        ElementTree.fromstring(image)


def boxes(svg):
    """(left, top, right, bottom) of each bar, and of the picture."""
    root = ElementTree.fromstring(svg)
    x, y, w, h = map(float, root.get("viewBox").split())
    found = []
    for p in root.iter("{http://www.w3.org/2000/svg}path"):
        if p.get("class") == "bar":
            xs, ys = [], []
            for letter, numbers in re.findall(r"([MHVLZ])([^MHVLZ]*)", p.get("d")):
                n = [float(k) for k in numbers.split()]
                xs += n[:1] if letter in "MHL" else []
                ys += n[-1:] if letter in "MVL" else []
            found.append((min(xs), min(ys), max(xs), max(ys)))
    return found, (x, y, x + w, y + h)


def test_bars_are_as_long_as_their_values():
    bars = [("b", 5.0), ("a", 10.0), ("c", 2.5)]
    up, page = boxes(charts.columns("t", "x", "y", bars))
    tall = [y1 - y0 for _, y0, _, y1 in up]
    assert tall == [400, 200, 100] and len({round(y1) for *_, y1 in up}) == 1
    lying, page2 = boxes(charts.rows("t", "x", bars))
    assert [x1 - x0 for x0, _, x1, _ in lying] == [240, 480, 120] and len({round(x0) for x0, *_ in lying}) == 1
    for found, (left, top, right, bottom) in ((up, page), (lying, page2)):
        assert all(left < x0 < x1 < right and top < y0 < y1 < bottom for x0, y0, x1, y1 in found)
    assert all(p[2] < q[0] for p, q in itertools.pairwise(up)) and all(p[3] < q[1] for p, q in itertools.pairwise(lying))


def test_figures_of_a_finished_analysis(spark, tmp_path):
    (tmp_path / "v_gene_usage.tsv").write_text("v_gene\treads\nIGHV1\t2\nIGHV4\t9\n")
    (tmp_path / "lineages.tsv").write_text("lineage\tn_unique_cdr3\tn_reads\tcdr3s\n" + "".join(f"{k}\t{900 // (k + 1) + 1}\t{5000 // (k + 1) + 1}\tACGT\n" for k in range(2000)))
    points = plots.abundance_points(germline.result_table(spark, str(tmp_path / "lineages.tsv"), germline.LINEAGE_SCHEMA), most=50)
    ranks = [r for r, _ in points["reads"]]
    assert ranks[0] == 1 and ranks[-1] == 2000 and ranks == sorted(set(ranks)) and len(ranks) <= 50
    assert points["reads"] == [(r, 5000 // r + 1) for r in ranks] and points["unique CDR3s"] == [(r, 900 // r + 1) for r in ranks]
    assert plots.main([str(tmp_path), str(tmp_path / "out")]) == 0
    for name, kind in (("v_gene_usage", "bar"), ("lineage_rank_abundance", "line")):
        svg = (tmp_path / "out" / f"{name}.svg").read_text()
        ElementTree.fromstring(svg)
        assert svg.count(f'<path class="{kind}"') == 2
    one = charts.abundance("t", {"a": [(1, 1)]})
    assert "nan" not in one and one.count('class="line"') == 1
    with pytest.raises(ValueError, match="series must not be empty."):
        charts.abundance("t", {"a": []})
    with pytest.raises(FileNotFoundError):
        plots.main([str(tmp_path / "none")])


def test_scales():
    assert [charts.nice_bound(v) for v in (-1, 0, 1, 1.5, 2, 3, 7, 10, 719, 0.03)] == [1, 1, 1, 2, 2, 5, 10, 10, 1000, 0.05]
    assert [charts.viridis(p) for p in (-1, 0, 0.5, 1, 2)] == ["#440154", "#440154", "#26828e", "#b4de2c", "#b4de2c"]
    assert charts.fractions(1) == [0] and charts.fractions(3) == [0, 0.5, 1]


def test_log_lines():
    assert logs.line("2031-01-02 03:04:05", "debug", "nodes: 7") == "2031-01-02 03:04:05 | debug    | nodes: 7"
    assert logs.line("now", "warning", "a | b") == "now | warning  | a | b"
    assert logs.level("WARNING") == logging.WARNING
    with pytest.raises(ValueError, match="LOUD"):
        logs.level("LOUD")


def test_command_line(spark, tmp_path, capsys):
    args = ["--igblast", str(DATA / "tie_heavy.tsv"), "--log-file", str(tmp_path / "log"), "--min-lineage-size", "3x"]
    args += [x for f in ("dump-lineages", "dump-usage", "weblogo-query", "usage-plot", "stats-plot") for x in (f"--{f}", str(tmp_path / f))]
    assert cli.main(args) == 0
    assert capsys.readouterr().out.splitlines()[3].strip().startswith("40  number of lineages represented by at least 3 unique")
    assert (tmp_path / "dump-lineages").read_text() == (DATA / "tie_heavy_lineages.tsv").read_text()
    assert (tmp_path / "dump-usage").read_text() == (DATA / "tie_heavy_usage.tsv").read_text()
    logo = (tmp_path / "weblogo-query").read_text()
    assert logo.count("\n") == 8 and not logo.endswith("\n")
    assert all((tmp_path / f).read_text().startswith("<svg") for f in ("usage-plot", "stats-plot"))
    log = (tmp_path / "log").read_text()
    assert log.endswith("Analysis complete.\n")
    assert " | info     | Loaded 242 sequences (120 unique CDR3s).\n" in log
    assert re.search(r"Hamming graph: 120 nodes, 120 edges, \d+ blocks scanned on \d+ worker\(s\)\.\n", log)


@pytest.mark.parametrize(("args", "code"), [(["--help"], 0), ([], 2), (["--igblast"], 2), (["--igblast", "x", "--what"], 2), (["--igblast", "x", "--workers", "two"], 2), (["--igblast", "x", "--log-level", "LOUD"], 2), (["--igblast", "/nowhere.tsv"], 1)])
def test_exit_codes(spark, args, code, capsys):
    assert cli.main(args) == code
    assert code == 0 or capsys.readouterr().err


def test_entry_works_without_the_text_operators(tmp_path):
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("cdrforge.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 20 and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.columns == ["metric", "value"] and got.count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
    assert got.where(F.col("value") > 0).count() >= 3
