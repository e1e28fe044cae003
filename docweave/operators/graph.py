"""Walks over edge tables as iterated joins whose rounds are stored."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rounds after which what was seen becomes one table.
MERGED = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. A local master without one gets a folder of its own; any other raises, for its executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _stored(df: DataFrame) -> DataFrame:
    """Written to the folder that the cluster shares, and read back: rounds neither pile up in the plan nor die with an executor."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/docweave-{spark.sparkContext.applicationId}/walk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000, most_nodes: int | None = None) -> DataFrame:
    """node and depth (fewest edges) of all nodes reachable from ``roots`` (node) over ``edges`` (source, target). Cycles are safe: a node is visited once. More nodes than ``most_nodes`` are an error."""
    edges = _stored(edges.select("source", "target").distinct())
    frontier = _stored(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, most_rounds + 1):
        step = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = _stored(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        if most_nodes is not None and seen.count() + frontier.count() > most_nodes:
            raise RuntimeError(f"traversal limit of {most_nodes} nodes")
        seen = seen.unionByName(frontier)
        if depth % MERGED == 0:  # so that the plan does not grow with the rounds
            seen = _stored(seen)
    raise RuntimeError(f"traversal limit of {most_rounds} rounds")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node and depth of everything that depends on the changed nodes, themselves included."""
    return reachable(reversed_edges(edges), changed)


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches."""
    return nodes.join(reachable(edges, roots).select("node"), "node", "left_anti")


def on_cycles(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Nodes of the part of the graph in which every node has a way in and a way out: what stays when ends are taken away round by round. All nodes on cycles, and those between cycles."""
    left = _stored(edges.select("source", "target").distinct())
    n = left.count()
    for _ in range(most_rounds):
        kept = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target")
        kept = _stored(kept.join(kept.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        m = kept.count()
        if m == n:
            return kept.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        left, n = kept, m
    raise RuntimeError(f"traversal limit of {most_rounds} rounds")
