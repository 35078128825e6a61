"""Line deduplication by site-relative frequency.

A line is boilerplate of its host if the share of the host's pages that hold it
exceeds a ratio and it repeats at all: a line of a single page is nobody's
boilerplate, be the host of one page. Lines are compared without white space around
them; blank lines are neither counted nor removed. Counting groups by host and line with partial
sums, so a host with a third of all pages is summed before it is shuffled. A host
has at most (lines a page) / ratio boilerplate lines; they join the pages as one
short array, and that join is broadcast only if the table's size, which is known
by then, is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cdrforge.storage import Scratch

#: Characters taken off both ends of a line before it is compared.
_BLANK = r" \t\r\u000b\u000c"
_TRIM = f"trim(BOTH '{_BLANK}' FROM l)"


def boilerplate_lines(docs: DataFrame, host_col: str, text_col: str, ratio: float, copies_once: bool = False) -> DataFrame:
    """(host, line hash) of the lines that repeat and are on more than ``ratio`` of the host's pages.

    ``copies_once``: a host's pages of the same lines count as one page.
    """
    hashes = F.expr(f"array_distinct(transform(filter(split(`{text_col}`, '\\n'), l -> {_TRIM} <> ''), l -> xxhash64({_TRIM})))")
    pages = docs.select(F.coalesce(F.col(f"`{host_col}`"), F.lit("")).alias("host"), hashes.alias("lines"))
    if copies_once:
        pages = pages.withColumn("lines", F.array_sort("lines")).distinct()
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    return counts.join(totals, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "line")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, broadcast_rows: int = 20_000, copies_once: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` with boilerplate lines taken out of the text, and n_lines, n_removed.

    ``n_lines`` counts lines that are not blank. A null text stays null and has
    none. Rows with a null host count as one host without a name. Rows with
    repeated ids are pages of their own. A column of ``docs`` named n_lines or
    n_removed is replaced; other columns stay as they are, whatever their names.
    An empty table gives an empty one. At most ``broadcast_rows`` (host, line)
    pairs are broadcast; more are joined by host. With ``copies_once`` pages of a
    host that hold the same lines are counted as one, so that copies of a text do
    not make its lines boilerplate.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    found = scratch.table(boilerplate_lines(docs, host_col, text_col, ratio, copies_once), "boilerplate")
    own = "__boilerplate_"
    by_host = found.groupBy(F.col("host").alias(f"{own}host")).agg(F.collect_list("line").alias(f"{own}lines"))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        by_host = F.broadcast(by_host)
    joined = docs.join(by_host, F.coalesce(F.col(f"`{host_col}`"), F.lit("")) == F.col(f"{own}host"), "left")
    gone = f"({_TRIM} <> '' and coalesce(array_contains({own}lines, xxhash64({_TRIM})), false))"
    split = f"split(`{text_col}`, '\\n')"
    out = joined.withColumn(f"{own}kept", F.expr(f"case when {own}lines is null then {split} else filter({split}, l -> not {gone}) end"))
    solid = lambda x: F.coalesce(F.expr(f"cast(size(filter({x}, l -> {_TRIM} <> '')) as long)"), F.lit(0))
    out = out.withColumn(f"{own}n", F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(solid(split)))
    out = out.withColumn(f"{own}r", F.col(f"{own}n") - F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(solid(f"{own}kept")))
    text = F.expr(f"case when `{text_col}` is not null then array_join({own}kept, '\\n') end").alias(text_col)
    plain = [text if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*plain, F.col(f"{own}n").alias("n_lines"), F.col(f"{own}r").alias("n_removed"))
