"""Connected components of a link table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in the links (a, b).

    A node's links are only ever aggregated to their minimum and joined with it, so a node with very many
    links is never gathered in one task. Rounds are logarithmic in the longest path; each is written to
    the shared folder. Union-find's pointer jumping is the small-star step.
    """
    edges = links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, and itself, link to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "edges")
        # stars only: nobody is both a centre and a leaf, and every leaf has one centre
        if after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            edges = after
            break
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
