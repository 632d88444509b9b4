"""Connected components of an edge list, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddymesh.llm.common import scratch, stored

#: Steps towards the root between two written tables.
JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges(a long, b long): root is the smallest node of its component.

    In a round every node that isn't the smallest among its neighbours hooks to the smallest of them, the forest is
    flattened by pointer jumping, and the edges are contracted to its roots: at least half of the roots that still
    have edges go, so the rounds are as the logarithm of the nodes. Each round is a written table; hubs are joined
    by plain equi-joins, which adaptive execution can split. Null ends and loops are no edges.
    """
    pair = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    with scratch() as kept:
        left = stored(edges.where("a <> b").select(*pair).distinct(), "edges")
        labels = left.select(F.col("hi").alias("node")).union(left.select("lo")).distinct().withColumn("root", F.col("node"))
        while not left.isEmpty():
            parent = stored(left.groupBy("hi").agg(F.min("lo").alias("up")), "parents")
            while True:
                above = parent.select(F.col("hi").alias("up"), F.col("up").alias("top"))
                jumped = parent.withColumn("moved", F.lit(False))
                for _ in range(JUMPS):
                    jumped = jumped.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("up"), (F.col("moved") | F.col("top").isNotNull()).alias("moved"))
                jumped = stored(jumped, "parents")
                parent = jumped.select("hi", "up")
                if jumped.where("moved").isEmpty():
                    break
            labels = stored(labels.join(parent.withColumnRenamed("hi", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            ends = left.join(parent, "hi", "left").select(F.coalesce("up", "hi").alias("a"), F.col("lo"))
            ends = ends.join(parent.withColumnRenamed("hi", "lo"), "lo", "left").select("a", F.coalesce("up", "lo").alias("b"))
            left = stored(ends.where("a <> b").select(*pair).distinct(), "edges")
        kept.append(labels := labels if hasattr(labels, "stored_at") else stored(labels, "labels"))
    return labels
