"""Connected components by alternating large-star and small-star steps.

Links stay distributed: a step is one aggregation to each node's smallest neighbour and one
join back, its result is written to the shared folder, and the steps end when nothing changes.
The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeline.runtime import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Links may repeat, run either way or join a node with itself; rows with a null are ignored.
    Without links the result is empty.
    """
    star = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    star = written(star.where("a IS NOT NULL AND b IS NOT NULL AND node <> root").distinct(), "links")
    before = None
    while (now := _digest(star)) != before:
        before = now
        star = written(_small_star(_large_star(star)), "links")
    roots = star.select(F.col("root").alias("node"), "root").distinct()
    return star.unionByName(roots)


def _digest(star: DataFrame) -> tuple:
    code = F.xxhash64("node", "root").cast("decimal(38,0)")
    return tuple(star.agg(F.count(F.lit(1)), F.sum(code)).first())


def _large_star(star: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = star.unionByName(star.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = both.groupBy("node").agg(F.min("root").alias("least")).withColumn("least", F.least("least", "node"))
    # Stored, so that the join reads two plain exchanges and a node with many links can be split.
    least = written(least, "least")
    moved = both.join(least, "node").where("root > node")
    return moved.select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()


def _small_star(star: DataFrame) -> DataFrame:
    """A node and its smaller neighbours meet at the smallest of them."""
    least = star.groupBy("node").agg(F.min("root").alias("least"))
    moved = star.join(least, "node").where("root <> least")
    return (
        moved.select(F.col("root").alias("node"), F.col("least").alias("root"))
        .unionByName(least.select("node", F.col("least").alias("root")))
        .distinct()
    )
