"""The whole analysis over a table of reads."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cdrforge.operators import clusters, collapse, lineages, similarity
from cdrforge.storage import Scratch


@dataclass
class Analysis:
    """Results of one repertoire, each built when first asked for.

    ``reads``: ord, cdr3, cdr3_aa, cdr_length, v_call, j_call, and the columns named in
    ``by``, such as a donor whose timepoints are pooled: each of their values is a
    repertoire of its own, in one run. Nodes and members are written once, whatever is
    asked for after.
    """

    reads: DataFrame
    ratio: float = 0.1
    least: int = 10
    by: tuple[str, ...] = ()

    @functools.cached_property
    def _scratch(self) -> Scratch:
        return Scratch(self.reads.sparkSession, "analysis")

    @functools.cached_property
    def nodes(self) -> DataFrame:
        """The nodes, and an ``id`` for joins: a long in place of a sequence."""
        # as many files as there are shuffle partitions: the join multiplies rows, so its scan must not be one task
        n = int(self.reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        nodes = collapse.collapse(self.reads, self.by).repartition(n, "cdr3").withColumn("id", F.monotonically_increasing_id())
        return self._scratch.table(nodes, "nodes")

    @functools.cached_property
    def edges(self) -> DataFrame:
        """(cdr_length, a, b): pairs of sequences, after the columns of ``by``."""
        return similarity.edges(self.nodes, self.ratio, by=self.by)

    @functools.cached_property
    def links(self) -> DataFrame:
        """(a, b): pairs of ids."""
        return similarity.edges(self.nodes, self.ratio, "id", by=self.by).select("a", "b")

    @property
    def loaded(self) -> DataFrame:
        return collapse.load_summary(self.reads, self.by)

    @property
    def graph(self) -> DataFrame:
        """n_nodes, n_edges, n_blocks: one row. Edges are counted where they are found."""
        sizes = [self.nodes.agg(F.count("*").alias("n_nodes")), self.links.agg(F.count("*").alias("n_edges")), similarity.block_sizes(self.nodes).agg(F.count("*").alias("n_blocks"))]
        return functools.reduce(DataFrame.crossJoin, sizes)  # one row each

    @functools.cached_property
    def members(self) -> DataFrame:
        found = clusters.clusters(self.nodes, self.ratio, self.by)
        return self._scratch.table(found.select(*self.by, "id", "cdr3", "n_reads", "component"), "members")

    @functools.cached_property
    def summaries(self) -> DataFrame:
        return lineages.summaries(self.members, self.by)

    @functools.cached_property
    def ranked(self) -> DataFrame:
        return lineages.ranked(self.summaries, self.by)

    @property
    def table(self) -> DataFrame:
        return lineages.table(self.members, self.by)

    @property
    def stats(self) -> DataFrame:
        return lineages.stats(self.summaries, self.least, self.by)

    @property
    def usage(self) -> DataFrame:
        return collapse.v_gene_usage(self.reads, self.by)

    @property
    def weblogo(self) -> DataFrame:
        return lineages.weblogo(self.reads, self.members)
