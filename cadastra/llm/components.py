"""Connected components of an edge table by alternating large and small stars.

Every step is a join or an aggregation over edges; nothing is collected. Neighbourhoods are
reduced to their smallest member by a partial aggregation, so a hub costs its task one row
per mapper. Each round's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import forget, materialise


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the component's smallest node.

    Edges may repeat, point either way or join a node to itself. An empty table gives an
    empty result. The rounds go on until a round changes nothing; their number grows with the
    logarithm of the longest chain.
    """
    now = (edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"))
           .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    now = materialise(now, "edges")
    nodes = now
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        large = materialise(large, "edges")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = materialise(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "edges")
        # done when no node hangs on two, and none both hangs on one and carries others
        ends = after.selectExpr("v AS n", "1 AS child", "0 AS parent").unionByName(after.selectExpr("u AS n", "0 AS child", "1 AS parent"))
        finished = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty()
        if now is not nodes:
            forget(now)
        forget(large)
        now = after
        if finished:
            break
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
