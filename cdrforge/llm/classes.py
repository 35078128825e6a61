"""Rows to the classes that they belong to, where a class may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_MOST = 1000


def join_classes(rows: DataFrame, named: DataFrame, spread: Column) -> DataFrame:
    """``rows`` (ka, kb, ...) and, where a class has the same ka and kb, the other columns of ``named`` (ka, kb, w, ...); null where none has.

    ``w`` counts a class's rows. Classes of a thousandth of all rows or more, of
    which there are 1000 at most, are joined by broadcast. Their rows, and those
    without a class, are then dealt by ``spread`` and not by their class, so that
    none lands in one task as a whole. Null keys match nothing.
    """
    others = [c for c in named.columns if c not in ("ka", "kb")]
    floor = max(1, (named.agg(F.sum("w")).first()[0] or 0) // _MOST)
    hot = named.where(F.col("w") > floor).select(F.col("ka").alias("__ha"), F.col("kb").alias("__hb"), *(F.col(c).alias(f"__h_{c}") for c in others))
    cold = named.where(F.col("w") <= floor).select(F.col("ka").alias("__ca"), F.col("kb").alias("__cb"), *(F.col(c).alias(f"__c_{c}") for c in others))
    x = rows.join(F.broadcast(hot), (F.col("ka") == F.col("__ha")) & (F.col("kb") == F.col("__hb")), "left")
    apart = F.col("__ha").isNotNull() | F.col("ka").isNull()
    x = x.withColumns({"__ja": F.when(apart, spread).otherwise(F.col("ka")), "__jb": F.when(~apart, F.col("kb"))})
    x = x.join(cold, (F.col("__ja") == F.col("__ca")) & (F.col("__jb") == F.col("__cb")), "left")
    return x.select(*rows.columns, *(F.coalesce(f"__h_{c}", f"__c_{c}").alias(c) for c in others))
