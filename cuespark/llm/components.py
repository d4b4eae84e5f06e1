"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, root of every node of the links (a, b); the root is the component's least node.

    Steps are taken until the links stand still; with ``rounds`` it is an error if that needs more.
    Each step writes its links to the shared folder.  Nothing is collected but a count and a
    checksum; neighbour minima are aggregates with map-side combination, and the joins of hubs
    with their many neighbours are left to skew-splitting.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in itertools.count() if rounds is None else range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if seen == (now["n"], now["h"]):
            break
        seen = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components aren't settled after {rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
