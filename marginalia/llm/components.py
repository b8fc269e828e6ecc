"""Connected components of a graph of links, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

MAX_ROUNDS = 60


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that it reaches.

    Alternates two steps until nothing changes, a number of rounds that follows the logarithm of the size of the
    components: each node links its larger neighbours to its smallest neighbour, then its smaller ones to the smallest.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        ends = F.explode(F.array("a", "b")).alias("end")
        small = large.join(lower, "a").select(ends, "least").select(F.col("end").alias("a"), F.col("least").alias("b"))
        edges = written(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
