"""Relational operators of the lineage analysis."""
