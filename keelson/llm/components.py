"""Connected components of a graph given as an edge table: large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any comparable type: rows (node, root), root the smallest node reachable, for all nodes of edges.

    Every round is two aggregations and two joins by node; the edge table never grows. Rounds go on until one changes nothing
    (of n nodes log n squared at most, by the paper; in practice a few), each cut by a checkpoint in the shared folder. Self-loops and repeated edges do no harm; null ends are ignored."""
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large star: neighbours greater than a node point to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        large = both.join(least, both.a == least.node).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        # small star: a node and its lesser neighbours point to the least of them
        low = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        small = large.join(low, large.a == low.node)
        edges = cut(
            small.where(F.col("b") != F.col("root")).select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(low.select(F.col("node").alias("a"), F.col("root").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
