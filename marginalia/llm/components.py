"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import settle

MOST_ROUNDS = 100


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) of long. (node, part): part is the smallest node of the component.

    Alternates large-star (every node sends its larger neighbours to its smallest one) and small-star (the same for smaller neighbours)
    until nothing changes; the number of rounds grows with the logarithm of the diameter, and no row ever holds a neighbourhood. It is
    an error if MOST_ROUNDS don't suffice.
    """
    edges = settle(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small.filter("u <> v").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part"))).groupBy("node").agg(F.min("part").alias("part"))
