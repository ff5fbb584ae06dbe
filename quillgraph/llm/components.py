"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)`` with root the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond") until every node hangs directly from its root. Each step's edges are written to the shared folder, so no
    step depends on an executor's disk, and nothing but a count and a checksum reaches the driver.
    Both sides of each join are plain exchanges of written tables: a hub's edges are split by
    adaptive execution. Self-loops and repeated or null edges are allowed and add nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, seen = staged(now, "edges"), None
    for _ in range(most_rounds):
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if sums["n"] == 0 or seen == (sums["n"], sums["s"]):
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = (sums["n"], sums["s"])
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large, "large")
        least = staged(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi")
        now = staged(small.select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
