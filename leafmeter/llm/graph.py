"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leafmeter.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b): the label is the least node that can be reached.

    Each round takes the least label among a node's neighbours and then the label of that label, so paths shorten
    by half or more a round.  A node with any number of edges is one row on one side of each join,
    and the other side is split by AQE; rounds end when no label changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("t_label"))
        after = stored(
            hooked.join(target, hooked["label"] == target["t"], "left").select(
                "node", "old", F.least("label", "t_label").alias("label")
            ),
            "labels",
        )
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            return labels
