"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize, release


def _star(pairs: DataFrame, keep) -> DataFrame:
    """For each node of `pairs` (node, other): its other ends that satisfy keep, tied to the least of node and all ends."""
    least = pairs.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    tied = pairs.join(least, "node").where(keep).select(F.col("other").alias("a"), F.col("low").alias("b"))
    own = least.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return tied.unionByName(own).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b) that is not the least of its component; root is that least node.

    Every round is two aggregations with map-side combine and two joins on a node, so a hub needs no task of its own; it is
    written to the shared folder, which cuts the lineage, and replaces the last one's table. Rounds grow with the logarithm of
    the longest chain; they end when nothing changes, which every component reaches, as no round raises a node's root.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        large = _star(both, F.col("other") > F.col("node")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        last, now = now, materialize(_star(large, F.lit(True)), "edges")
        release(last)
        # Sums of hashes do not depend on order; the count tells sets of different size apart.
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
