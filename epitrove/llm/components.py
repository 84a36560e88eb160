"""Connected components of a distributed graph by alternating large and small stars.

Every round is a minimum per node and a join of the links with it, so no task holds the links of a
component. A node with very many links is summed up before it is shuffled. The minima are stored before
they are joined back: so both sides of the join come straight from a shuffle, and Spark can split the links of a
hot node. (Joined to the aggregate itself, they would have to stay with its partitioning.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epitrove.plans.storage import pin

MOST_ROUNDS = 60


def _stars(links: DataFrame) -> DataFrame:
    """Large star, then small star: every node hangs on the smallest node it knows of."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")
    least = pin(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = pin(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
    least = pin(large.groupBy("b").agg(F.min("a").alias("m")))
    return (
        large.join(least, "b")
        .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                                  F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
        .select("x.*").where("a < b").distinct()
    )


def _is_star(links: DataFrame) -> bool:
    """Whether every node is either a centre or a leaf with one link."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))).alias("x"))
    sums = ends.select("x.*").groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf"))
    return sums.where("centre + leaf > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node that can be reached) for every node with a link.

    ``links`` has columns a and b in any order; links of a node with itself and repeats are ignored,
    and so are links with a null. The links of each round are written to the shared folder.
    """
    links = pin(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    for _ in range(MOST_ROUNDS):
        if _is_star(links):
            break
        links = pin(_stars(links))
    else:
        raise RuntimeError(f"the components did not settle within {MOST_ROUNDS} rounds")
    hubs = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(hubs)
