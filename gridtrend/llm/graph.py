"""Connected components over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrend.llm.common import keep



def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b); root is the
    smallest node of the component.

    Each round takes the smallest label among a node and its neighbours, hands it
    to the node's present root, and follows one pointer. Labels only fall, so the
    rounds end, after about the logarithm of the longest path. Every round is one
    written table; edges to a node with very many neighbours are aggregated on the
    map side first.
    """
    both = keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = keep(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root"))
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        seen = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        offers = seen.select(F.col("root").alias("node"), "low").union(seen.select("node", "low"))
        parent = keep(offers.groupBy("node").agg(F.min("low").alias("up")))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
        after = keep(parent.join(above, "up").select("node", "root"))
        moved = after.join(labels.withColumnRenamed("root", "was"), "node").filter("root <> was")
        done = moved.isEmpty()
        labels = after
        if done:
            return labels
