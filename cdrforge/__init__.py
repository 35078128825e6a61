"""Clonal-lineage analytics and corpus preparation on Spark DataFrames."""
