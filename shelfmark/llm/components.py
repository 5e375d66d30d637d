"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (``a, b``, any order, repeats allowed): the
    smallest node that it reaches. Each round takes the smallest root among the neighbours and
    then the root's own root, so distances shrink fast; only counts reach the driver."""
    both = materialise(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        better = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        better = materialise(better)
        roots = better.select(F.col("node").alias("via"), F.col("root").alias("far"))
        jumped = better.join(roots, better["root"] == roots["via"]).select("node", "old", F.least("root", "far").alias("root"))
        jumped = materialise(jumped)
        labels = jumped.select("node", "root")
        if jumped.where("root <> old").limit(1).count() == 0:
            return labels
