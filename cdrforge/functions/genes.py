"""Gene calls: comma lists of names with allele suffixes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_alleles(call: Column) -> Column:
    """Every ``*`` with digits after it goes; a ``*`` before anything else stays."""
    return F.regexp_replace(call, r"\*[0-9]+", "")


def gene_calls(call: Column) -> Column:
    """Sorted distinct gene names of a call; none for a null or blank one.

    Blank is tested before alleles are stripped, so ``*01`` alone is one nameless
    gene. Empty names between commas count, and spaces round names stay.
    """
    names = F.array_sort(F.array_distinct(F.split(strip_alleles(call), ",", -1)))
    return F.when(F.trim(F.coalesce(call, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(names)


def genes_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def smallest_common(a: Column, b: Column) -> Column:
    """The first name both sorted lists hold; null if none."""
    return F.array_min(F.array_intersect(a, b))
