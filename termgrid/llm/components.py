"""Connected components by alternating large-star and small-star steps, each a minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of the component of each node of an undirected graph. Loops and repeats are allowed.

    Every round is written to the shared folder. No node's neighbours are gathered: a minimum is combined before its
    shuffle, and the join of a node with many neighbours can be split. Rounds grow with the logarithm of the size.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select("a", "b") if small else e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        turned = both.join(least, "a")
        if small:
            out = turned.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = turned.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter("a <> b").distinct()

    e = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    nodes = None
    fingerprint = lambda t: t.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
    while True:
        # large-star leaves pairs with a > b again; small-star needs them so
        large = star(e, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = materialize(star(large, True), "edges")
        seen = fingerprint(e)
        if seen == nodes:
            break
        nodes = seen
    found = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
