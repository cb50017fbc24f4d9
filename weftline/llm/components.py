"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Links that one task writes.
TASK_LINKS = 200_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Nulls and self-links are ignored; repeated links and either direction are fine; no links give
    an empty table.  Each round is two joins on the node, so a node of many links is a skewed key
    that adaptive execution splits; minima are combined before the shuffle.  Each round's links are a
    stored table, which replaces that of the round before.  Only a count and a checksum of the links reach the driver.
    """
    edges = stored(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the number of links never grows, so few links need few tasks
        old = edges
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(before[0] // TASK_LINKS + 1))
        discard(old)
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    ).groupBy("node").agg(F.min("component").alias("component"))
