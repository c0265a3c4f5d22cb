"""Connected components over a table of links, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links(a, b): label is the smallest node that is reachable.

    Every round each node takes the smallest label around it, then its label's
    label, so rounds grow with the logarithm of a component's width.  Labels are
    written to the shared folder each round.  No links give no rows.
    """
    both = scratch.table(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links"
    )
    labels = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = scratch.table(low.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
