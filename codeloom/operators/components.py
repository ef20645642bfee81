"""Connected components by star contraction, for links that don't fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b; longs, not null); the root is the component's smallest node.

    In each round every node passes the smallest node that it knows to its
    neighbours, first to the larger and then to the smaller ones. Only minima are
    gathered per node, so a hub costs one row per task. The rounds needed grow
    with the logarithm of a component's size. Each round's links are written, so
    a lost executor costs at most one round.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    links, before = materialize(links.distinct(), "links"), None
    while True:
        links = materialize(_small_star(_large_star(links)), "links")
        after = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    passed = links.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
