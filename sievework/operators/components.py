"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and a join on the node, whose hot side adaptive execution may
split, so that a node with very many neighbours is no unit of work. Nothing is collected but two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """The edges after one step, written; what it needs meanwhile is deleted."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # written, so that the join's sides are plain shuffles, which Spark can split at a node with many neighbours
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    if large:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    else:
        pushed = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = pushed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    out = materialise(out, "edges")
    release(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component): the smallest node reachable. Nodes without an edge don't appear.

    Self-loops and rows with a null end are ignored; repeated edges do no harm; no edges give no rows. The number of steps grows
    with the logarithm of the edges; they end when the edges are stars, each node at its smallest.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        count, nodes = now.agg(F.count("*"), F.count_distinct("u")).first()
        if count == nodes and now.join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        larger = _star(now, large=True)
        after = _star(larger, large=False)
        release(larger)
        release(now)
        now = after
