"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import FILE_ROWS, cut


def connected(edges: DataFrame, most_edges: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes of edges (a, b).

    Alternating large-star and small-star steps: every node's neighbours are linked to the smallest of them, until each
    component is a star around its smallest node. most_edges, if known, and file_rows say how the edges are first written. The number of steps grows with the logarithm of a
    component's diameter; each is an aggregate and a join on nodes, cut at the shared folder. Nothing is collected.
    """
    now = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most_edges, file_rows)
    count = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("mark"))
    mark = count.first()
    while mark["n"]:
        # Large star: neighbours above a node go to the smallest of its neighbours and itself.
        ways = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = ways.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, mark["n"])
        # Small star: a node and its neighbours below it go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small, 2 * mark["n"])
        again = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("mark")).first()
        if again == mark:
            break
        mark = again
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), 2 * mark["n"])


def grown(component: DataFrame, edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """component (node, component) with further edges (a, b): only the components that edges join are worked on anew.
    most_rows: what edges and component have at most together, if known."""
    a = component.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    named = cut(edges.select("a", "b").join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), most_rows)
    over = connected(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")), most_rows).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    fresh = named.where(F.col("a") == F.col("ca")).select(F.col("a").alias("node"), F.col("ca").alias("component")).union(named.where(F.col("b") == F.col("cb")).select(F.col("b").alias("node"), F.col("cb").alias("component")))
    return component.union(fresh).distinct().join(over, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
