"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import landed


def _roots(parents: DataFrame) -> DataFrame:
    """Follow parents (``node``, ``label``), which are never greater than their node, up to the roots."""
    while True:
        up = parents.select(F.col("node").alias("_at"), F.col("label").alias("_up"))
        step = parents.join(up, F.col("label") == F.col("_at"), "left")
        step = landed(step.select("node", F.coalesce("_up", "label").alias("label"), F.col("label").alias("was")), "labels")
        parents = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (least node of the component) for every node of the edges (``a``, ``b``, longs).

    In each step every node takes its least neighbour as parent, parents are followed to their roots by doubling, and
    the edges shrink to those between different roots. The steps end when no edge is left; each is written out, so an
    executor may be lost at any time. A node with very many edges is reduced by a partial minimum, and meets its label in
    a join that adaptive execution can split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    links, labels = landed(both.distinct(), "links"), None
    while True:
        parents = links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
        roots = _roots(landed(parents, "labels"))
        if labels is None:
            labels = roots
        else:
            to = roots.select(F.col("node").alias("label"), F.col("label").alias("_to"))
            labels = landed(labels.join(to, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        one = links.join(roots.select(F.col("node").alias("a"), F.col("label").alias("_a")), "a")
        two = one.join(roots.select(F.col("node").alias("b"), F.col("label").alias("_b")), "b").filter("_a <> _b")
        links = landed(two.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
