"""Antibody reads derived from the ``orders`` table, as AIRR columns.

``dense``: 211 families whose members differ in one place. ``wide``: 997 families
whose members differ in up to eight, so there are many singletons and ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cdrforge.plans.analysis import Analysis
from cdrforge.sources.airr import normalise

_LETTERS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_CALLS = """case when k % 3 = 0 then concat('IGHV', f % 7, '*01,IGHV', (f + k) % 7, '*02') else concat('IGHV', f % 7, '*0', k % 9 + 1) end v_call,
  concat('IGHJ', f % 6, '*01') j_call, 1 cdr3_start, int(len) cdr3_end"""
DENSE = f"""
with b as (select o_orderkey k, o_custkey % 211 f, translate(concat(md5(cast(o_custkey % 211 as string)), md5(cast(o_custkey % 211 + 1000 as string))), {_LETTERS}) s from {{orders}}),
  m as (select k, f, 30 + 3 * (f % 4) len, substr(s, 1, int(30 + 3 * (f % 4))) s, int(k % (30 + 3 * (f % 4)) + 1) p, substr('ACGT', int((k div 7) % 4 + 1), 1) c from b),
  r as (select k, f, len, case when k % 5 = 0 then s else concat(substr(s, 1, p - 1), c, substr(s, p + 1)) end cdr3 from m)
select k read_id, cdr3, translate(substr(cdr3, 1, int(10 + k % 5)), 'A', ' ') cdr3_aa, {_CALLS} from r"""
WIDE = f"""
with b as (select o_orderkey k, o_custkey % 997 f from {{orders}}),
  h as (select k, f, 30 + 3 * (f % 4) len, concat(md5(cast(f as string)), md5(cast(f + 1000 as string))) s0, md5(cast(k as string)) hk from b),
  l as (select k, f, len, substr(translate(s0, {_LETTERS}), 1, int(len)) s, translate(substr(hk, 1, 8), {_LETTERS}) ins, int(k % 9) w, int((k div 9) % (len - 8) + 1) p from h),
  r as (select k, f, len, concat(substr(s, 1, p - 1), substr(ins, 1, w), substr(s, p + w)) cdr3 from l)
select k read_id, cdr3, translate(substr(cdr3, 1, int(10 + k % 5)), 'A', ' ') cdr3_aa, {_CALLS} from r"""


def raw(spark: SparkSession, sf_dir: str, sql: str = WIDE) -> DataFrame:
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def reads(spark: SparkSession, sf_dir: str, sql: str = WIDE) -> DataFrame:
    return normalise(raw(spark, sf_dir, sql), F.col("read_id"))


def analysis(spark: SparkSession, sf_dir: str, sql: str = WIDE) -> Analysis:
    return Analysis(reads(spark, sf_dir, sql))

#: Reads spelled from texts: a line's words in runs, each word four letters of its hash, so that a changed word stays within a tenth.
TEXT = f"""
with l as (select doc_id, lang donor, posexplode(split(text, '\\n')) (line, value) from {{docs}}),
  w as (select doc_id, donor, line, filter(split(value, '[ \\t\\r]+'), x -> x <> '') ws from l),
  s as (select doc_id, donor, line, k, slice(ws, int(k * {{size}} + 1), {{size}}) ws from (select *, explode(sequence(0, (size(ws) - 1) div {{size}})) k from w where size(ws) > 0)),
  c as (select doc_id, donor, line, k, array_join(transform(ws, x -> translate(substr(md5(x), 1, 4), {_LETTERS})), '') cdr3 from s)
select doc_id, donor, line, k, cdr3, '' cdr3_aa, concat('IGHV', k % 7 + 1, '*01') v_call, 'IGHJ1*01' j_call, 1 cdr3_start, int(length(cdr3)) cdr3_end from c"""


def text_reads(docs: DataFrame, size: int = 12) -> DataFrame:
    """Reads of a documents table, donor by language: every ``size`` words of a line are one, its last ones too. The tables hold no sequences; texts stand for sequencing runs that grow."""
    raw = docs.sparkSession.sql(TEXT, docs=docs, size=size)
    return normalise(raw, F.struct("doc_id", "line", "k"), ["donor"])


def donors(orders: DataFrame, n: int = 5) -> DataFrame:
    """Reads of an orders table with a donor each."""
    raw = orders.sparkSession.sql(WIDE, orders=orders)
    keyed = raw.withColumn("donor", F.concat(F.lit("D"), F.col("read_id") % n))
    return normalise(keyed, F.col("read_id"), ["donor"])
