"""DuckDB SQL of each query, straight from the definitions."""

from __future__ import annotations

from cdrforge.sinks.charts import VIRIDIS

_LETTERS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_CALLS = """case when k % 3 = 0 then 'IGHV' || (f % 7) || '*01,IGHV' || ((f + k) % 7) || '*02' else 'IGHV' || (f % 7) || '*0' || (k % 9 + 1) end v_call, 'IGHJ' || (f % 6) || '*01' j_call"""
_RAW = f"raw as (select k read_id, cdr3, translate(substr(cdr3, 1, cast(10 + k % 5 as int)), 'A', ' ') cdr3_aa, {_CALLS}, cast(len as int) cdr_length from r)"
_DENSE = f"""b as (select o_orderkey k, o_custkey % 211 f, translate(md5(cast(o_custkey % 211 as varchar)) || md5(cast(o_custkey % 211 + 1000 as varchar)), {_LETTERS}) s from orders),
m as (select k, f, 30 + 3 * (f % 4) len, substr(s, 1, cast(30 + 3 * (f % 4) as int)) s, cast(k % (30 + 3 * (f % 4)) + 1 as int) p, substr('ACGT', cast((k // 7) % 4 + 1 as int), 1) c from b),
r as (select k, f, len, case when k % 5 = 0 then s else substr(s, 1, p - 1) || c || substr(s, p + 1) end cdr3 from m), {_RAW}"""
_WIDE = f"""b as (select o_orderkey k, o_custkey % 997 f from orders),
h as (select k, f, 30 + 3 * (f % 4) len, md5(cast(f as varchar)) || md5(cast(f + 1000 as varchar)) s0, md5(cast(k as varchar)) hk from b),
l as (select k, f, len, substr(translate(s0, {_LETTERS}), 1, cast(len as int)) s, translate(substr(hk, 1, 8), {_LETTERS}) ins, cast(k % 9 as int) w, cast((k // 9) % (len - 8) + 1 as int) p from h),
r as (select k, f, len, substr(s, 1, p - 1) || substr(ins, 1, w) || substr(s, p + w) cdr3 from l), {_RAW}"""
_GENES = "list_sort(list_distinct(string_split(regexp_replace({0}, '\\*[0-9]+', '', 'g'), ',')))"
_READS = f"reads as (select read_id, cdr3, cdr3_aa, cdr_length, {_GENES.format('v_call')} v, {_GENES.format('j_call')} j from raw)"
_NODES = "nodes as (select cdr3, arg_min(cdr_length, read_id) cdr_length, list_sort(list_distinct(flatten(list(v)))) v, list_sort(list_distinct(flatten(list(j)))) j, count(*) n_reads from reads group by cdr3)"
_EDGES = "edges as (select a.cdr_length, a.cdr3 a, b.cdr3 b from nodes a join nodes b on a.cdr_length = b.cdr_length and a.cdr3 < b.cdr3 and list_has_any(a.v, b.v) and list_has_any(a.j, b.j) and hamming(a.cdr3, b.cdr3) <= cast(0.1 as double) * a.cdr_length)"
_LINEAGES = """sym as (select a, b from edges union all select b, a from edges),
reach(n, r) as (select cdr3, cdr3 from nodes union select sym.b, reach.r from reach join sym on sym.a = reach.n),
members as (select n cdr3, min(r) root from reach group by n),
lineages as (select row_number() over (order by count(*) desc, root) - 1 lineage, root, count(*) n_unique_cdr3, cast(sum(n_reads) as bigint) n_reads, string_agg(cdr3, ',' order by cdr3) cdr3s from members join nodes using (cdr3) group by root)"""


def _over(upto: str, select: str, raw: str = _WIDE) -> str:
    parts = {"raw": [raw], "reads": [raw, _READS], "nodes": [raw, _READS, _NODES], "edges": [raw, _READS, _NODES, _EDGES], "lineages": [raw, _READS, _NODES, _EDGES, _LINEAGES]}[upto]
    return f"with recursive {', '.join(parts)} {select}"


_USAGE = "select v_gene, count(*) reads from (select unnest(v) v_gene from reads) group by v_gene"
_CHUNKS = "select cdr3, pos, substr(cdr3, cast(pos * (length(cdr3) // n) + least(pos, length(cdr3) % n) + 1 as bigint), cast(length(cdr3) // n + case when pos < length(cdr3) % n then 1 else 0 end as bigint)) chunk from (select cdr3, n, cast(unnest(range(n)) as int) pos from (select cdr3, cast(floor(cast(0.1 as double) * cdr_length) as int) + 1 n from nodes))"
_METRICS = """select 0 ord, 'number of clonal lineages' metric, count(*) as value from lineages
union all select 1, 'number of unique CDR3s in the largest clonal lineage', coalesce(max(n_unique_cdr3), 0) from lineages where lineage = 0
union all select 2, 'number of sequences in the largest clonal lineage', coalesce(max(n_reads), 0) from lineages where lineage = 0
union all select 3, 'number of lineages represented by at least 10 unique CDR3s', count(*) filter (n_unique_cdr3 >= 10) from lineages
union all select 4, 'number of lineages represented by at least 10 sequences', count(*) filter (n_reads >= 10) from lineages"""
_LOGO = "select read_id, rpad(aa, cast(max(length(aa)) over () as int), '*') aa from (select read_id, translate(cdr3_aa, ' ', '*') aa from reads join members using (cdr3) join lineages using (root) where lineage = 0)"

#: Stops of the colour scale, the axis's end and each bar's place.
_BARS = f"""with recursive {_WIDE}, {_READS}, usage as ({_USAGE}),
bars as (select v_gene || ' & <' || reads || '>' as name, reads, cast(row_number() over (order by reads desc, v_gene) - 1 as int) place, greatest(count(*) over () - 1, 1) as last, pow(10, floor(log10(max(reads) over ()))) p, max(reads) over () / p m from usage),
placed as (select *, p * case when m <= 1 then 1 when m <= 2 then 2 when m <= 5 then 5 else 10 end bound, place / last * 8 as spot, cast(floor(spot) as int) as low, least(low + 1, 8) as high from bars),
stops as (select {', '.join(f'{[c[k] for c in VIRIDIS]} {n}' for k, n in enumerate(('r', 'g', 'bl')))})
select place, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as name, reads / bound as share, bound, '#' || {' || '.join(f"format('{{:02x}}', cast(floor({c}[low + 1] + ({c}[high + 1] - {c}[low + 1]) * (spot - low) + 0.5) as int))" for c in ("r", "g", "bl"))} colour from placed, stops"""

SQL: dict[str, str] = {
    "scan_reads": _over("reads", "select read_id, cdr3, cdr3_aa, cdr_length, array_to_string(v, ',') v_call, array_to_string(j, ',') j_call from reads"),
    "strip_allele_suffixes": _over("raw", "select read_id, regexp_replace(v_call, '\\*[0-9]+', '', 'g') v_stripped, regexp_replace(j_call, '\\*[0-9]+', '', 'g') j_stripped from raw"),
    "gene_call_lists": _over("reads", "select read_id, cast(len(v) as bigint) n_genes, array_to_string(v, ',') v_call from reads"),
    "load_summary": _over("reads", "select count(*) n_reads, count(distinct cdr3) n_unique_cdr3, count(*) filter (length(cdr3) <> cdr_length) n_length_differs from reads"),
    "unique_cdr3": _over("nodes", "select cdr3, cdr_length, n_reads, array_to_string(v, ',') v_call, array_to_string(j, ',') j_call from nodes"),
    "reads_per_cdr3": _over("reads", "select cdr3, count(*) n_reads from reads group by cdr3"),
    "block_sizes": _over("nodes", "select cdr_length, v, j, count(*) n, count(*) * (count(*) - 1) // 2 pairs from (select cdr_length, v, unnest(j) j from (select cdr_length, unnest(v) v, j from nodes)) group by cdr_length, v, j"),
    "sequence_distance": _over("reads", "select read_id, hamming(cdr3, reverse(cdr3)) d_native, hamming(cdr3, reverse(cdr3)) d_bytes from reads"),
    "pigeonhole_chunks": _over("nodes", _CHUNKS),
    "gene_overlap": _over("reads", "select read_id, list_has_any(v, ['IGHV2', 'IGHV4', 'IGHV6']) shared, list_min(list_intersect(v, ['IGHV2', 'IGHV4', 'IGHV6'])) common from reads"),
    "hamming_edges": _over("edges", "select cdr_length, a, b from edges"),
    "hamming_edges_dense": _over("edges", "select cdr_length, a, b from edges", _DENSE),
    "hamming_edges_reference": _over("edges", "select cdr_length, a, b from edges"),
    "graph_summary": _over("edges", "select (select count(*) from nodes) n_nodes, (select count(*) from edges) n_edges, (select count(*) from (select distinct cdr_length, v, unnest(j) j from (select cdr_length, unnest(v) v, j from nodes))) n_blocks"),
    "clonal_lineages": _over("lineages", "select lineage, root, n_unique_cdr3, n_reads from lineages"),
    "clonal_lineages_dense": _over("lineages", "select lineage, root, n_unique_cdr3, n_reads from lineages", _DENSE),
    "lineage_table": _over("lineages", "select lineage, n_unique_cdr3, n_reads, cdr3s from lineages"),
    "lineage_read_counts": _over("lineages", "select root, n_reads from lineages"),
    "largest_lineage": _over("lineages", "select root, n_unique_cdr3, n_reads from lineages where lineage = 0"),
    "lineage_stats": _over("lineages", f"select metric, value from ({_METRICS})"),
    "stats_report": _over("lineages", f"select case when length(n) < 8 then lpad(n, 8, ' ') else n end || '  ' || metric line from (select format('{{:,}}', cast(value as bigint)) n, metric from ({_METRICS}))"),
    "lineage_report": _over("lineages", "select lineage, concat_ws(chr(9), lineage, n_unique_cdr3, n_reads, cdr3s) line from lineages"),
    "usage_report": _over("reads", f"select v_gene, concat_ws(chr(9), v_gene, reads) line from ({_USAGE})"),
    "airr_file": _over("reads", "select cdr3, cdr3_aa, cdr_length, array_to_string(v, ',') v_call, array_to_string(j, ',') j_call from reads"),
    "airr_files": _over("reads", "select cdr3, cdr3_aa, cdr_length, array_to_string(v, ',') v_call, array_to_string(j, ',') j_call from reads where read_id % 3 = 0 or read_id % 11 <> 0"),
    "edge_sets_equal": _over("edges", "select count(*) n_left, count(*) n_right, true equal from edges"),
    "lineage_file": _over("lineages", "select lineage, n_unique_cdr3, n_reads, cdr3s from lineages"),
    "usage_file": _over("reads", _USAGE),
    "rank_abundance": _over("lineages", "select lineage + 1 as rank, n_unique_cdr3, n_reads from lineages"),
    "v_gene_usage": _over("reads", _USAGE),
    "v_gene_usage_ranked": _over("reads", f"select v_gene, reads, row_number() over (order by reads desc, v_gene) bar from ({_USAGE})"),
    "top_v_genes": _over("reads", f"select * from ({_USAGE}) order by reads desc, v_gene limit 6"),
    "chart_bars": _BARS,
    "weblogo_file": _over("lineages", f"select aa from ({_LOGO})"),
    "weblogo_rows": _over("lineages", _LOGO),
    "fasta_records": _over("reads", "select 'R' || read_id accession, array_to_string(j, ',') || '_Mus_spretus' gene, cdr3 as sequence from reads"),
}

_PARTS = "with p as (select p_partkey k, translate(md5(cast(p_partkey as varchar)) || md5(cast(p_partkey + 1 as varchar)), '0123456789abcdef', 'acgt.acgt.acgt..') s from part)"
#: Each allele with its set, its place in it and, for V genes, the bounds of its regions.
_ALLELES = _PARTS + """, a as (select k, s, 'set ' || (k % 5) || ' R.' || (k % 5) % 2 title, cast(row_number() over (partition by k % 5 order by k) - 1 as int) pos, 'A' || k || '*01' label,
  substr('VDJ', cast(k % 3 + 1 as int), 1) sequence_type, 'IG' || substr('HKL', cast(k % 2 + 1 as int), 1) locus from p)"""
_BOUNDS = {"fwr1_end": "k % 5 + 3", "cdr1_start": "k % 5 + 4", "cdr1_end": "k % 5 + 9", "fwr2_start": "k % 5 + 10", "fwr2_end": "20", "cdr2_start": "21", "cdr2_end": "30 + k % 3", "fwr3_start": "33", "fwr3_end": "60 + k % 9"}
_WITHOUT = ", ".join(f"cast({e} - (length(s[1:{e}]) - length(replace(s[1:{e}], '.', ''))) as int) {c}" for c, e in _BOUNDS.items())
_ANNOTATION = f"select pos, label, 1 fwr1_start, {_WITHOUT}, sequence_type || right(locus, 1) chain, 0 frame from a where sequence_type = 'V'"
_REGIONS = ", ".join(f"cast(k * {n + 1} % 97 as int) {r}_{e}" for n, (r, e) in enumerate((r, e) for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3") for e in ("start", "stop")))

SQL |= {
    "germline_species": _PARTS + "select ['Homo sapiens', 'Homo sapiens', 'Mus musculus'][k % 3 + 1] species, ['IGH', 'TRB', 'IGK'][k % 3 + 1] locus, ['V', 'J', 'V'][k % 3 + 1] segment, 'A' || k || '|' || k % 7 as header, s as sequence from p",
    "imgt_rewrite": _PARTS + "select unnest(['>' || case k % 3 when 0 then 'TRBV' else 'IGHV' end || k % 40 || '*01' || case when k % 4 = 0 and k % 3 <> 0 then '_Mus_spretus' else '' end, replace(s, '.', ''), '>oddheader|' || k]) as value from p",
    "germline_alleles": _ALLELES + "select title, pos, label, sequence_type, locus, s coding_sequence, cast(case when k % 3 <> 0 then 0 when k % 2 = 0 then 2 else 1 end as int) n_delineations from a",
    "germline_fasta": _ALLELES + "select pos, sequence_type, '>' || label || chr(10) || replace(s, '.', '') as record from a",
    "germline_titles": _ALLELES + "select sequence_type, ' ' || string_agg(title, '  ' order by title) title from (select distinct sequence_type, title from a) group by sequence_type",
    "germline_v_annotation": f"{_ALLELES} {_ANNOTATION}",
    "germline_annotation_lines": f"{_ALLELES} select pos, concat_ws(chr(9), label, fwr1_start, {', '.join(_BOUNDS)}, chain, frame) line from ({_ANNOTATION})",
    "v_annotation_table": f"{_PARTS} select 'IGHV' || k || '*01' as name, {_REGIONS}, 'V' || substr('HK', cast(k % 2 + 1 as int), 1) chain, '0' frame from p",
    "j_auxiliary_table": _PARTS + "select 'IGHJ' || k || '*01' as name, cast(k % 3 as int) frame, 'JH' chain, cast(case when k % 3 > 0 then k % 50 end as int) cdr3_stop, cast(case when k % 3 > 0 then k % 2 end as int) extra_bp from p",
    "d_frame_table": _PARTS + "select 'IGHD' || k as name, cast(k % 3 as int) as start from p",
    "blast_metadata": _PARTS + "select 'parts' dbname, cast(sum(length(s)) as bigint) letters, count(*) as sequences from p",
}

#: Lineages of each donor, where ``reads`` have one.
_DONOR_LINEAGES = """nodes as (select donor, cdr3, arg_min(cdr_length, ord) cdr_length, list_sort(list_distinct(flatten(list(v)))) v, list_sort(list_distinct(flatten(list(j)))) j, count(*) n_reads from reads group by donor, cdr3),
keyed as (select *, unnest(v) g from nodes),
edges as (select distinct a.donor, a.cdr_length, a.cdr3 a, b.cdr3 b from keyed a join keyed b on a.cdr_length = b.cdr_length and a.g = b.g and a.donor is not distinct from b.donor and a.cdr3 < b.cdr3 and list_has_any(a.j, b.j) and hamming(a.cdr3, b.cdr3) <= cast(0.1 as double) * a.cdr_length),
sym as (select donor, a, b from edges union all select donor, b, a from edges),
reach(donor, n, r) as (select donor, cdr3, cdr3 from nodes union select reach.donor, sym.b, reach.r from reach join sym on sym.a = reach.n and sym.donor is not distinct from reach.donor),
members as (select donor, n cdr3, min(r) root from reach group by donor, n),
lineages as (select m.donor, row_number() over (partition by m.donor order by count(*) desc, root) - 1 lineage, root, count(*) n_unique_cdr3, cast(sum(n_reads) as bigint) n_reads from members m join nodes n on m.cdr3 = n.cdr3 and m.donor is not distinct from n.donor group by m.donor, root)"""
_DONOR_READS = f"reads as (select read_id ord, 'D' || (read_id % 5) donor, cdr3, cdr_length, {_GENES.format('v_call')} v, {_GENES.format('j_call')} j from raw)"
_TEXT_READS = f"""l as (select doc_id, lang donor, unnest(string_split(text, chr(10))) txt, generate_subscripts(string_split(text, chr(10)), 1) line from documents),
w as (select doc_id, donor, line, list_filter(regexp_split_to_array(txt, '[ \\t\\r]+'), lambda x: x <> '') ws from l),
s as (select doc_id, donor, line, ws, unnest(range(0, (len(ws) + 11) // 12)) k from w where len(ws) > 0),
reads as (select struct_pack(d := doc_id, l := line, k := k) ord, donor, array_to_string(list_transform(ws[k * 12 + 1 : k * 12 + 12], lambda x: translate(substr(md5(x), 1, 4), {_LETTERS})), '') cdr3, cast(length(cdr3) as int) cdr_length, ['IGHV' || (k % 7 + 1)] v, ['IGHJ1'] j from s)"""

_EACH = "select donor, lineage, root, n_unique_cdr3, n_reads from lineages"
DONOR_LINEAGES = f"with recursive {_WIDE}, {_DONOR_READS}, {_DONOR_LINEAGES} {_EACH}"
TEXT_LINEAGES = f"with recursive {_TEXT_READS}, {_DONOR_LINEAGES} {_EACH}"

_DONOR_METRICS = ["count(*)", "max(n_unique_cdr3) filter (lineage = 0)", "max(n_reads) filter (lineage = 0)", "count(*) filter (n_unique_cdr3 >= 10)", "count(*) filter (n_reads >= 10)"]
_NAMED = ["number of clonal lineages", "number of unique CDR3s in the largest clonal lineage", "number of sequences in the largest clonal lineage", "number of lineages represented by at least 10 unique CDR3s", "number of lineages represented by at least 10 sequences"]
SQL |= {
    "donor_lineages": DONOR_LINEAGES,
    "donor_stats": f"with recursive {_WIDE}, {_DONOR_READS}, {_DONOR_LINEAGES} " + " union all ".join(f"select donor, '{n}' metric, cast({m} as bigint) as value from lineages group by donor" for n, m in zip(_NAMED, _DONOR_METRICS, strict=True)),
    "donor_v_gene_usage": f"with {_WIDE}, {_DONOR_READS} select donor, v_gene, count(*) reads from (select donor, unnest(v) v_gene from reads) group by donor, v_gene",
}
