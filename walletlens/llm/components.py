"""Connected components of a link table by repeated minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walletlens.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so long chains shrink by more than half. Rounds are cut by written tables below the shared
    folder, which survive lost executors. A node with very many links is combined before each
    shuffle. Null ends and links of a node with itself join nothing but keep their node.
    """
    ends = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(ends.union(ends.select("b", "a")).distinct(), "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("through"), F.col("label").alias("beyond"))
        step = lower.join(jump, lower["label"] == jump["through"], "left").select(
            "node", "before", F.least("label", F.coalesce("beyond", "label")).alias("label")
        )
        step = materialize(step, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> before").isEmpty():
            return labels
