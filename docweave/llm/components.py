"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (least node reachable) of every node of ``edges`` (a, b).

    Each round takes the least label of all neighbours (a minimum, so partial
    aggregation keeps hubs cheap) and then the label of the label, which doubles
    the reach of labels. Every round is written to the shared folder, so the plan
    does not grow and lost executors cost a read.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(lower.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), "labels")
        if new.filter("label <> was").isEmpty():
            break
        labels = new.select("node", "label")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
