"""DuckDB SQL of the queries that SQL can express, straight from their contracts."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = "words as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i, len(ws) n from (select doc_id, regexp_extract_all({text}, '" + _WORD + "') ws from documents))"

LINE_DEDUP = r"""
with l as (select doc_id, host, ln, i, trim(ln, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) t from (
  select doc_id, coalesce(source, '') host, unnest(string_split(text, chr(10))) ln, generate_subscripts(string_split(text, chr(10)), 1) i from documents)),
pages as (select coalesce(source, '') host, count(*) pages from documents group by 1),
boiler as (select host, t from (select host, t, count(distinct doc_id) n from l where t <> '' group by host, t) join pages using (host) where n > 1 and n > cast(0.05 as double) * pages),
kept as (select doc_id, count(*) filter (l.t <> '') n_lines, count(*) filter (b.t is not null) n_removed, coalesce(string_agg(ln, chr(10) order by i) filter (b.t is null), '') txt
  from l left join boiler b on b.host = l.host and b.t = l.t group by doc_id)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, case when d.text is not null then sha256(coalesce(txt, '')) end kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id"""

SUBSTRING_DEDUP = (
    "with "
    + _WORDS.format(text="text")
    + """,
g as (select doc_id, i, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 12 following) k, n from words),
f as (select k, min(doc_id) m from g where i <= n - 12 group by k),
gone as (select distinct g.doc_id, unnest(range(i, i + 13)) i from g join f using (k) where i <= n - 12 and m < g.doc_id),
kept as (select words.doc_id, count(*) n_words, count(gone.i) n_removed, coalesce(string_agg(w, ' ' order by words.i) filter (gone.i is null), '') txt
  from words left join gone on gone.doc_id = words.doc_id and gone.i = words.i group by words.doc_id)
select d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(txt, '')) kept_sha256 from documents d left join kept k on k.doc_id = d.doc_id"""
)

NEAR_DEDUP = (
    "with recursive "
    + _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
s as (select distinct doc_id, sh from (select doc_id, n, i, case when n = 1 then w else w || ' ' || lead(w) over (partition by doc_id order by i) end sh from words) where sh is not null),
n as (select doc_id, count(*) c from s group by doc_id),
links as (select a.doc_id a, b.doc_id b from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where 100 * na.c >= 80 * nb.c and 100 * nb.c >= 80 * na.c group by a.doc_id, b.doc_id, na.c, nb.c having 100 * count(*) >= 80 * (na.c + nb.c - count(*))),
sym as (select a, b from links union all select b, a from links),
reach(x, r) as (select doc_id, doc_id from documents union select sym.b, reach.r from reach join sym on sym.a = reach.x),
c as (select x doc_id, min(r) component_id from reach group by x)
select c.doc_id, coalesce(n.c, 0) n_shingles, component_id, component_id = c.doc_id kept from c left join n on n.doc_id = c.doc_id"""
)

SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP, "op7_substring_dedup": SUBSTRING_DEDUP, "op8_minhash_near_dedup": NEAR_DEDUP}
