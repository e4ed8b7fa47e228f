"""Connected components of a graph of links, in rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.storage import discard, join_often, materialize, often


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is its smallest node.

    Each round takes the smallest label among a node's neighbours, then the
    label of that label, so that chains shorten by half. Labels are written to
    the shared folder after each round. The label of a node with very many links
    is sent to its neighbours' tasks. Defined cases: links of a node to
    itself and repeated links change nothing; without links, no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "links", (links, links))
    hubs = often(both, "b")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels", (both,))
    while True:
        near = join_often(both, labels.withColumnRenamed("node", "b"), "b", hubs, 32).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        of = labels.where("component < node").select(F.col("node").alias("component"), F.col("component").alias("further"))
        fresh = materialize(lower.join(of, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component")), "labels", (both,))
        discard(labels)
        labels = fresh.select("node", "component")
        labels._written_at = fresh._written_at
        if fresh.where("component <> old").isEmpty():
            return labels


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links (a, b), found among the components that these touch: a graph of one node for each."""
    end = lambda x: more.select("nth", F.col(x).alias("node")).join(labels, "node", "left").select("nth", F.coalesce("component", "node").alias(x))
    more = materialize(more.withColumn("nth", F.monotonically_increasing_id()), "more-links")
    between = materialize(end("a").join(end("b"), "nth").select("a", "b").where("a <> b").distinct(), "between", (more,))
    moved = components(between).select(F.col("node").alias("component"), F.col("component").alias("low"))
    nodes = labels.unionByName(more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component")))
    return materialize(nodes.join(moved, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels", (labels, more))
