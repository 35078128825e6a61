import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cdrforge.operators import collapse, lineages, similarity
from cdrforge.plans.adapters import donors, text_reads
from cdrforge.plans.analysis import Analysis
from cdrforge.storage import Scratch
from jobs import clone_catalogue, config, donor_repertoires

SF = "/root/testdata/sf0.001"
SETTINGS = {"ratio": 0.1, "min_lineage_size": 10, "donors": 5, "files_per_donor": 2}
GROWING = {"ratio": 0.1, "words": 12, "files_per_load": 1000, "files_per_donor": 2}


def content(spark, path):
    rows = spark.read.parquet(path)
    return sorted((tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()), key=repr)


def brute(rows, ratio=0.1):
    """Lineages of (cdr3, genes, n) from all pairs."""
    names = sorted(rows)
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if len(a) == len(b) and rows[a][0] & rows[b][0] and sum(x != y for x, y in zip(a, b, strict=True)) <= ratio * len(a):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    groups = {}
    for n in names:
        groups.setdefault(root(n), []).append(n)
    order = sorted(groups, key=lambda r: (-len(groups[r]), r))
    return [(k, r, len(groups[r]), sum(rows[n][1] for n in groups[r])) for k, r in enumerate(order)]


def by_brute(reads):
    """All donors' lineages of a table of reads."""
    found = {}
    for r in reads.collect():
        genes, n = found.setdefault(r["donor"], {}).get(r["cdr3"], (frozenset(), 0))
        found[r["donor"]][r["cdr3"]] = genes | set(r["v_call"]), n + 1
    return sorted(((d, *x) for d, rows in found.items() for x in brute(rows)), key=repr)


def catalogue(spark, out):
    return sorted((tuple(r) for r in clone_catalogue.table(spark, f"{out}/lineages", clone_catalogue.LINEAGES).select("donor", "lineage", "root", "n_unique_cdr3", "n_reads").collect()), key=repr)


A = [f"alpha{i}" for i in range(12)]
NEAR, FILL = [*A[:5], "other", *A[6:]], [f"filler{i}" for i in range(12)]


def line(*words):
    return " ".join(w for ws in words for w in ws)


LOADS = [
    [(1, line(A), "en"), (2, line(A) + "\n\n" + line(FILL, FILL), "de"), (3, None, "en"), (4, "", "fr"), (5, " \t\r\n", None)],
    [(6, line(FILL, NEAR), "en"), (7, line(NEAR), "de"), (8, line(NEAR[:3]), None)],  # the same gene as A's in one of them only
    [(9, line(FILL, A), "en"), (9, line(FILL, A), "en"), (None, line(A[:3]), None)],  # A takes up the gene by which NEAR is its neighbour
]


def add(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(folder)


def test_a_catalogue_over_growing_input(spark, tmp_path):
    """Each run takes the new files only; after each the output is that of all reads so far. A run without new files changes nothing."""
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    sizes = []
    for k, rows in enumerate(LOADS):
        add(spark, rows, source)
        assert clone_catalogue.run(spark, source, out, mark, GROWING) == 1
        assert catalogue(spark, out) == by_brute(text_reads(spark.read.parquet(source)))
        assert {r["load"] for r in spark.read.parquet(f"{out}/nodes").select("load").distinct().collect()} == set(range(k + 1))
        sizes.append(len([r for r in catalogue(spark, out) if r[0] == "en" and r[3] > 1]))
    assert sizes == [0, 0, 1]
    before = {t: content(spark, f"{out}/{t}") for t in ("nodes", "edges", "lineages", "members")}
    assert clone_catalogue.run(spark, source, out, mark, GROWING) == 0
    assert {t: content(spark, f"{out}/{t}") for t in before} == before
    # a load that is repeated after a failure writes what it wrote
    clone_catalogue.add_load(spark.createDataFrame(LOADS[2], "doc_id long, text string, lang string"), 2, out, GROWING)
    assert {t: content(spark, f"{out}/{t}") for t in before} == before


def test_a_catalogue_file_by_file_of_the_table(spark, tmp_path):
    """Many small loads end where one load of everything does; only new pairs are written by each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    assert clone_catalogue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", GROWING | {"files_per_load": 1}) == 4
    reads = text_reads(spark.read.parquet(f"{tmp_path}/in"))
    assert catalogue(spark, f"{tmp_path}/out") == by_brute(reads)
    a = Analysis(reads, by=("donor",))
    want = sorted(((r["donor"], r["a"], r["b"]) for r in a.edges.collect()), key=repr)
    rows = spark.read.parquet(f"{tmp_path}/out/edges").collect()
    assert sorted(((r["donor"], r["a"], r["b"]) for r in rows), key=repr) == want


def test_a_catalogue_of_one_file_and_of_none(spark, tmp_path):
    add(spark, LOADS[0], f"{tmp_path}/in")
    part = next((tmp_path / "in").glob("*.parquet"))
    clone_catalogue.run(spark, str(part), f"{tmp_path}/out", f"{tmp_path}/mark", GROWING)
    assert catalogue(spark, f"{tmp_path}/out") == by_brute(text_reads(spark.read.parquet(str(part))))
    (tmp_path / "none").mkdir()
    assert clone_catalogue.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/mark2", GROWING) == 0
    assert catalogue(spark, f"{tmp_path}/out2") == []


def test_repertoires_of_two_donors_are_two_runs(spark, tmp_path):
    reads = donors(spark.read.parquet(f"{SF}/orders.parquet"), 2)
    both = Analysis(reads, by=("donor",))
    for d in ("D0", "D1"):
        one = Analysis(reads.where(F.col("donor") == d))
        for name in ("ranked", "stats", "usage", "loaded"):
            want, got = getattr(one, name), getattr(both, name).where(F.col("donor") == d)
            columns = [c for c in want.columns if c != "component"]
            assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())), name
        assert sorted(map(tuple, both.edges.where(F.col("donor") == d).drop("donor").collect())) == sorted(map(tuple, one.edges.collect()))
        assert sorted(map(str, both.table.where(F.col("donor") == d).drop("donor").collect())) == sorted(map(str, one.table.collect()))
        assert lineages.largest(both.summaries, ("donor",)).where(F.col("donor") == d).select("root", "n_reads").first() == lineages.largest(one.summaries).select("root", "n_reads").first()


def test_repertoires_job(spark, tmp_path):
    reads = donors(spark.read.parquet(f"{SF}/orders.parquet"), 3).withColumn("donor", F.expr("nullif(donor, 'D2')"))
    out = f"{tmp_path}/out"
    first = donor_repertoires.run(reads, out, SETTINGS)
    tables = {t: content(spark, f"{out}/{t}") for t in donor_repertoires.TABLES}
    assert first == {t: len(rows) for t, rows in tables.items()} == donor_repertoires.run(reads, out, SETTINGS)
    assert {t: content(spark, f"{out}/{t}") for t in tables} == tables
    assert sorted(map(tuple, spark.read.parquet(f"{out}/lineages").select("donor", "lineage", "root", "n_unique_cdr3", "n_reads").collect()), key=repr) == by_brute(reads)
    assert sum(r[0] is None for r in tables["stats"]) == 5
    # one donor alone: the others keep theirs
    donor_repertoires.run(reads.where("v_call[0] = 'IGHV1'"), out, SETTINGS, only=["D1"])
    lone = spark.read.parquet(f"{out}/usage")
    assert lone.where("donor = 'D0'").count() > 1 and {r["v_gene"] for r in lone.where("donor = 'D1'").collect()} < {r["v_gene"] for r in lone.where("donor = 'D0'").collect()}


def test_repertoires_of_airr_folders_from_the_command_line(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(donor_repertoires, "session", lambda: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    for donor, rows in (("D1", ["V1*01\tJ1\tAAAACCCC\tKP\t1\t8"] * 2), ("D2", ["V1\tJ1\tAAAACCCG\tKP\t1\t8", "V1\tJ1\tTTTTCCCG\tFP\t1\t8"])):
        (tmp_path / donor).mkdir()
        (tmp_path / donor / "reads.tsv").write_text("\n".join(["v_call\tj_call\tcdr3\tcdr3_aa\tcdr3_start\tcdr3_end", *rows]) + "\n")
    (tmp_path / "own.json").write_text(json.dumps({"ratio": 0.2}))
    donor_repertoires.main(["--airr", f"{tmp_path}/D*/reads.tsv", "--out", f"{tmp_path}/out", "--config", f"{tmp_path}/own.json"])
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/lineages").select("donor", "lineage", "root", "n_unique_cdr3", "n_reads").collect())
    assert got == [("D1", 0, "AAAACCCC", 1, 2), ("D2", 0, "AAAACCCG", 1, 1), ("D2", 1, "TTTTCCCG", 1, 1)]


def test_settings(tmp_path):
    own = tmp_path / "own.json"
    own.write_text('{"ratio": 0.2}')
    assert config.load("clone_catalogue", str(own)) == config.load("clone_catalogue") | {"ratio": 0.2}
    own.write_text('{"ration": 0.2}')
    with pytest.raises(ValueError, match="ration"):
        config.load("clone_catalogue", str(own))


def test_edges_with_a_fresh_end(spark):
    reads = text_reads(spark.read.parquet(f"{SF}/documents.parquet").limit(80))
    nodes = collapse.collapse(reads, ("donor",)).withColumn("fresh", F.expr("pmod(xxhash64(cdr3), 3) = 0"))
    fresh = {(r["donor"], r["cdr3"]) for r in nodes.where("fresh").collect()}
    every = [tuple(r) for r in similarity.edges(nodes, by=("donor",)).collect()]
    assert sorted(every, key=repr) == sorted(map(tuple, similarity.edges_by_definition(nodes, by=("donor",)).collect()), key=repr) and len(every) > 5
    want = sorted((e for e in every if (e[0], e[2]) in fresh or (e[0], e[3]) in fresh), key=repr)
    for block in (4096, 2):
        assert sorted(map(tuple, similarity.edges(nodes, by=("donor",), fresh="fresh", block=block).collect()), key=repr) == want


def test_pairs_of_a_load_are_written_once(spark, tmp_path, monkeypatch):
    """To the table of edges, and to no table beside it; donors and sequences whose ends could run together stay apart."""
    written, write = [], clone_catalogue.Scratch.write
    monkeypatch.setattr(clone_catalogue.Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    clone_catalogue.add_load(spark.createDataFrame(LOADS[0], "doc_id long, text string, lang string"), 0, f"{tmp_path}/out", GROWING)
    assert "found" in written and "pairs" not in written
    names = spark.createDataFrame([("1", "AC"), (None, "1:1AC"), ("1A", "C"), ("", "-AC"), (None, "AC")], "donor string, cdr3 string")
    assert names.select(clone_catalogue._name("cdr3")).distinct().count() == 5


def test_a_load_leaves_the_catalogue_only(spark, tmp_path, monkeypatch):
    """Lineages are ranked once, what a load needs on the way goes when it is done, and all-new nodes are shuffled to their pairs once."""
    scratches, ranked, plans = [], lineages.ranked, []
    monkeypatch.setattr(clone_catalogue, "Scratch", lambda *args: scratches.append(Scratch(*args)) or scratches[-1])
    monkeypatch.setattr(lineages, "ranked", lambda *args: plans.append(1) or ranked(*args))
    edges = similarity.edges
    monkeypatch.setattr(similarity, "edges", lambda *args, **named: plans.append(named["fresh"]) or edges(*args, **named))
    for k in (0, 1):
        plans.clear()
        clone_catalogue.add_load(spark.createDataFrame(LOADS[k], "doc_id long, text string, lang string"), k, f"{tmp_path}/out", GROWING)
        assert plans == [(None, "fresh")[k], 1]
    assert len(scratches) == 2 and not any(Path(s.base.removeprefix("file://")).exists() for s in scratches)
