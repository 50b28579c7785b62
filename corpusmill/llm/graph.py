"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import keep, release


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node of its component, for every node with an edge.

    ``edges``: a, b, of one type; repeated edges and loops change nothing. Each round links all larger
    neighbours of a node to its smallest neighbour and then all smaller ones, which halves the way to the
    root; rounds are written to the shared folder, and none collects a node's neighbours: the smallest one
    is an aggregate, so a node with a third of all edges is no larger task than others.
    """
    pairs = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = keep(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        # A star forest: every node has one edge, and no root has one.
        unfinished = new.groupBy("u").count().where("count > 1").select(F.lit(1)).unionAll(
            new.join(new.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1))
        )
        done = unfinished.isEmpty()
        release(pairs)
        pairs = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
