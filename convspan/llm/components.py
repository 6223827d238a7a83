"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspan.llm.common import checkpointed, join_hubs

#: Components of a path of n nodes need about log2(n) rounds; more rounds than this mean that something is wrong.
MOST_ROUNDS = 60
#: Edges (16 bytes each) that one partition holds.
EDGES_PER_PART = 200_000


def parts_for(rows: int) -> int:
    """Partitions that so many edges, or other rows of a few longs, need. One needs no shuffle, whose tasks the driver keeps account of."""
    return 1 + rows // EDGES_PER_PART


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v), of which the round has so many, with the least neighbour of u, itself included, as m."""
    if parts_for(rows) == 1:
        return edges.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), "u"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return join_hubs(edges, least, "u", 2 * rows).withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _least(both, rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own, other = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    return _least(down, rows).select(F.inline(F.when(F.col("v") == F.col("m"), F.array(own)).otherwise(F.array(own, other)))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads to a node that leads no further."""
    onward = edges.select(F.col("u").alias("v")).distinct()
    return edges.select("v").distinct().join(onward, "v", "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component of every node of links(u, v), two long columns; a component's name is its least node.

    Rounds end when the edges are a star around each component's least node. Every round's edges, fewer than nodes and links together,
    are written to the checkpoint folder, in as many parts as they need; up to EDGES_PER_PART of them go round without a shuffle. Links of a node with itself add nothing; an empty table gives
    an empty one.
    """
    edges = checkpointed(links.select("u", "v").where("u <> v").distinct())
    for _ in range(MOST_ROUNDS):
        rows = edges.count()
        parts = parts_for(rows)
        edges = checkpointed(_large_star(edges.coalesce(parts), rows).coalesce(parts))
        edges = checkpointed(_small_star(edges.coalesce(parts), rows).coalesce(parts))
        if _settled(edges.coalesce(parts)):
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
