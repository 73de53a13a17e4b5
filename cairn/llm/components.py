"""Connected components by alternating stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest node reachable by links (a, b); nodes without a link are not in it.

    Each round links every node's neighbours to the smallest one: first its larger neighbours, then it and its smaller
    ones. Rounds end when nothing changes, after a number that grows with the logarithm of the longest chain. No
    neighbourhood is ever gathered: a minimum and a join do the work, so hot nodes stay splittable.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links", rows=links.count())
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        large = materialize(large, "large-star", rows=2 * state[0])
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).toDF("a", "b")
        old, edges = edges, materialize(small.union(least.select("m", "b").toDF("a", "b")).where("a < b").distinct(), "small-star", rows=4 * state[0])
        release(old, large)
        now = _state(edges)
        if now == state:
            nodes = materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct()), "components", rows=2 * state[0])
            release(edges)
            return nodes
        state = now
