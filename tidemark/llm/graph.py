"""Connected components over written edge tables; nothing of the graph comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _star(edges: DataFrame) -> DataFrame:
    """One round over edges (u, v), v < u: every node's larger neighbours are tied to its least
    neighbour or itself, then every node and its smaller neighbours to the least of them.
    moved: the round changed that edge; where none did, each node has one edge, to its least.

    What is shuffled is the least neighbour of each node, and the edges by either end.
    """
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
    in_order = Window.partitionBy("u").orderBy("v", F.desc("moved"))
    whole = large.select("u", "v", "moved", F.lag("v").over(in_order).alias("before"), F.min("v").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    whole = whole.where("before is null or before <> v")
    return whole.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, v): every node but the least of its component, and that least one.

    Null ends and loops count for nothing, repeated edges once. Rounds grow with the logarithm of
    the longest path; each is a written table, so a lost executor costs one round's tasks at most.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while True:
        now = stage(_star(now.select("u", "v")), "edges")
        if not now.agg(F.max("moved")).first()[0]:
            return now.select("u", "v")
