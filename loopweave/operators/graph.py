"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable over ``edges`` (a, b), for every node of an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every round is joins and aggregates on node ids,
    the number of rounds grows with the logarithm of the diameter, and only counts and a checksum reach the driver. Raises an
    error if the last of ``max_rounds`` still changed edges.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        following = written(small, "edges")
        state = tuple(following.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first())
        discard(now)
        now = following
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    pairs = now.groupBy("u").agg(F.min("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), "component").union(pairs.select(F.col("component").alias("node"), "component")).distinct()
