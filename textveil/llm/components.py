"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut, row_count

#: Nodes to a task, and tasks that there are whatever the nodes.
TASK_NODES, TASKS = 50_000, 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by one of its nodes.

    In each round every node joins that of itself and its neighbours which comes first in an
    order drawn anew for the round, and edges are drawn between what they joined.  The nodes that
    are left fall by a constant factor a round, on chains too.  Only minima are grouped, so a
    node of very many edges is summed up where its edges lie.  Tasks are as many as the nodes ask
    for: tables get small, and a round has several shuffles.  What the nodes joined is broadcast
    where the nodes are few, so that a round's joins shuffle nothing.
    """
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    labels = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")))
    nodes, turn = row_count(labels), 0
    tasks, slim = TASKS + nodes // TASK_NODES, by_size(nodes)
    edges, labels = edges.coalesce(tasks), labels.coalesce(tasks)
    while not edges.isEmpty():
        turn += 1
        draw = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy("a").agg(F.min(draw("b")).alias("near")).select(F.col("a").alias("old"), F.least(F.col("near"), draw("a"))["to"].alias("new"))
        joined = slim(cut(joined.coalesce(tasks), free=False))
        labels = cut(labels.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component")).coalesce(tasks), free=False)
        for end in ("a", "b"):
            edges = edges.join(joined, F.col(end) == F.col("old")).drop(end, "old").withColumnRenamed("new", end).coalesce(tasks)
        edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(tasks))
    return labels
