"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable from each end of an edge.

    `edges` has src and dst of one type; direction, repeats, self loops and rows with a null end don't matter.
    Alternating large-star and small-star rounds: each moves edges towards the least neighbour, the number of
    rounds grows with the logarithm of the diameter, and no neighbourhood is gathered into one row. Lineage is cut
    in the shared checkpoint folder every round.
    """
    clean = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    own = clean.select(F.col("src").alias("node")).union(clean.select("dst")).distinct()
    links = checkpointed(clean.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    sign = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the least of its neighbourhood
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of a node, and the node, are linked to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = checkpointed(small.distinct())
        new = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (new["n"], new["h"]) == sign:
            break
        sign = (new["n"], new["h"])
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return own.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def endpoints(links: DataFrame) -> DataFrame:
    """(node): the distinct ends of edges (src, dst), which is all that a view of a graph needs besides its edges."""
    return links.select(F.col("src").alias("node")).union(links.select("dst")).where("node is not null").distinct()
