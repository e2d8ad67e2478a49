"""Connected components of a graph of integer nodes, by large-star and small-star steps on edges.

Each round hangs a node's larger neighbours on its least one, then its smaller ones; the edges shrink to stars in a number of rounds
that grows with the logarithm of the size. Minima are taken before rows are exchanged, and the edges of hubs meet theirs where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


#: A node with more edges than this, and than a MOST_HUBS-th of all, is a hub: so there are fewer than MOST_HUBS.
HUB = 1000
MOST_HUBS = 100_000


def with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v) to (u, v, m), m the least v of u; rows: how many there are. Rows of hubs aren't exchanged: their least ones are broadcast (fewer than MOST_HUBS rows)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    bound = max(HUB, rows // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bound).select("u", "m"))
    few = edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= bound).select("u", "m"), "u")
    return few.unionByName(edges.join(hubs, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root): root is the least node of its component; roots have no row of their own."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where(F.col("a") != F.col("b")).select(u, v).distinct(), "edges")
    rows, seen = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = written(small.distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        rows, seen = state[0], state
