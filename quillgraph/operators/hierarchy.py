"""Closures of a child-parent relation and lifting to levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import settled


def closure(edges: DataFrame, nodes: DataFrame, max_depth: int = 8) -> DataFrame:
    """``edges(child, parent)`` -> (node, ancestor, depth), least depth, self at 0.

    Frontier joins by level: each step adds only pairs not seen at a smaller depth, so cycles and diamonds end by themselves. ``max_depth`` bounds the
    plan; administrative trees have five or six levels. A deeper hierarchy is an error when the rows are read, never a part of its pairs."""
    edges = edges.where("child is not null and parent is not null").select("child", "parent").distinct()
    seen = nodes.select(F.col("node"), F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    step = seen
    for d in range(1, max_depth + 2):  # one step more than may add pairs
        step = step.join(edges, step["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        seen = seen.unionAll(step)
    out = seen.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    return out.where(F.when(F.col("depth") > max_depth, F.raise_error(F.lit(f"the hierarchy is deeper than max_depth = {max_depth}")).cast("boolean")).otherwise(F.lit(True)))


def full_closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As :func:`closure`, for hierarchies of any depth and with cycles, in as many rounds as the logarithm of the greatest depth.

    A round joins the pairs at depth ``n`` exactly with all pairs up to ``n``: a nearest ancestor at a depth from ``n + 1`` to ``2 * n`` has, on the way to it, one at ``n``. So nothing is derived but pairs of the result, once for each
    shortest way through that ancestor. Rounds end when none adds a pair, which cycles do by themselves. Each round's new pairs are written to the shared folder (:func:`staging.settled`)."""
    edges = edges.where("child is not null and parent is not null and child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    seen, n = settled(edges), 1
    while True:
        far = seen.where(F.col("depth") == n).select("node", F.col("ancestor").alias("by"))
        on = seen.select(F.col("node").alias("by"), "ancestor", (F.col("depth") + n).alias("depth"))
        reached = far.join(on, "by").where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = settled(reached.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        seen, n = seen.unionAll(fresh), 2 * n
    own = nodes.select("node").distinct()
    return own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionAll(seen.join(own, "node", "left_semi").select("node", "ancestor", "depth"))


def _paths(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``step(node, to)``, one row a node -> (node, to, n, total) of all paths that end: the last node, the number of nodes after the first and the sum of their ids; and (node, low) of the nodes on cycles, by their cycle's least id, or None.

    A round doubles the length of all paths. What still runs when the nodes that paths have come to are as many as before and no path has met a lesser id runs in cycles, and these nodes are the cycles."""
    now, before = settled(step.select("node", "to", F.lit(1).cast("long").alias("n"), F.col("to").alias("total"), F.col("to").alias("low"), F.lit(False).alias("ended"))), None
    while True:
        on = now.select(F.col("node").alias("to"), F.col("to").alias("next"), *(F.col(x).alias(f"{x}_on") for x in ("n", "total", "low", "ended")))
        runs = now.where("NOT ended").join(on, "to", "left")
        least = F.least("low", "low_on")  # without nulls: the path's own where it ends
        told = runs.select("node", F.coalesce("next", "to").alias("to"), *((F.col(x) + F.coalesce(f"{x}_on", F.lit(0))).alias(x) for x in ("n", "total")), least.alias("low"), F.coalesce("ended_on", F.lit(True)).alias("ended"), (least < F.col("low")).alias("fell"))
        now = settled(told.unionAll(now.where("ended").withColumn("fell", F.lit(False))))
        left = now.where("NOT ended").agg(F.countDistinct("to").alias("ends"), F.count_if("fell").alias("fell")).first()
        if not left["ends"]:
            return now.select("node", "to", "n", "total"), None
        if left["ends"] == before and not left["fell"]:
            break
        before = left["ends"]
    runs = now.where("NOT ended")
    cyclic = settled(runs.select("node", "low").join(runs.select(F.col("to").alias("node")).distinct(), "node", "left_semi"))
    return _paths(step.join(cyclic, "node", "left_anti"))[0], cyclic


def ancestor_totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(child, parent)``, ids as long -> (node, ancestors, keys): how many ancestors each node has, itself left out, and the sum of their ids; a row for each of ``nodes(node)`` that has any.

    Nodes above which everything has one parent at most need no pairs: paths are doubled with their totals, in rows as many as the nodes, and a cycle counts once. Nodes that reach one with several parents may come to an ancestor in several ways;
    they, and only they, are counted from the pairs of :func:`full_closure`."""
    edges = edges.where("child is not null and parent is not null and child <> parent").select(F.col("child").cast("long"), F.col("parent").cast("long")).distinct()
    parents = edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to"))
    ended, cyclic = _paths(parents.where("n = 1").select("node", "to"))
    if cyclic is None:
        cyclic = nodes.limit(0).select(F.col("node").cast("long"), F.col("node").cast("long").alias("low"))
    rings = cyclic.groupBy("low").agg(F.count(F.lit(1)).alias("ring_n"), F.sum("node").alias("ring"))
    around = cyclic.join(rings, "low").select("node", (F.col("ring_n") - 1).alias("ring_n"), (F.col("ring") - F.col("node")).alias("ring"), "low")
    further = ended.join(around.withColumnRenamed("node", "to"), "to", "left")
    totals = further.select("node", (F.col("n") + F.coalesce("ring_n", F.lit(0))).alias("ancestors"), (F.col("total") + F.coalesce("ring", F.lit(0))).alias("keys"), F.coalesce("low", "to").alias("end"))
    totals = totals.unionAll(around.select("node", F.col("ring_n").alias("ancestors"), F.col("ring").alias("keys"), F.col("low").alias("end")))
    own = nodes.select(F.col("node").cast("long")).distinct()
    forks = settled(parents.where("n > 1").select(F.col("node").alias("end")))
    if forks.isEmpty():
        return totals.join(own, "node", "left_semi").select("node", "ancestors", "keys")
    totals = settled(totals)
    several = totals.join(forks, "end", "left_semi").select("node").unionAll(forks.select("end"))
    above = edges.join(forks, F.col("child") == F.col("end"), "left_semi").select(F.col("parent").alias("node")).join(totals, "node").select("end")
    basins = above.unionAll(forks).distinct()
    part = totals.join(basins, "end", "left_semi").select("node").unionAll(forks.select("end"))
    closed = full_closure(edges.join(part, F.col("child") == F.col("node"), "left_semi"), several.join(own, "node", "left_semi"))
    counted = closed.where("depth > 0").groupBy("node").agg(F.count(F.lit(1)).alias("ancestors"), F.sum("ancestor").alias("keys"))
    plain = totals.join(forks, "end", "left_anti").join(own, "node", "left_semi").select("node", "ancestors", "keys")
    return plain.unionAll(counted)


def lift(closed: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """(node, lifted): self or the nearest ancestor at the level; the least id among equals."""
    at = levels.where(F.col("level") == level).select(F.col("place_id").alias("ancestor"))
    return closed.join(at, "ancestor").groupBy("node").agg(F.min(F.struct("depth", "ancestor"))["ancestor"].alias("lifted"))


def subtree(closed: DataFrame, root: str) -> DataFrame:
    return closed.where(F.col("ancestor") == root).select("node")


def descendants_at(closed: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """(root, node): every root's descendants, itself included, at the level."""
    return closed.join(levels.where(F.col("level") == level).select(F.col("place_id").alias("node")), "node").select(F.col("ancestor").alias("root"), "node")


def centroids(closed: DataFrame, points: DataFrame) -> DataFrame:
    """(node, lat, lon): own coordinates, else the mean over the subtree. ``points(place_id, lat, lon)``."""
    below = closed.join(points.withColumnRenamed("place_id", "node"), "node").groupBy("ancestor").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    own = points.select(F.col("place_id").alias("ancestor"), "lat", "lon")
    return below.join(own, "ancestor", "left").select(F.col("ancestor").alias("node"), F.coalesce("lat", "mlat").alias("lat"), F.coalesce("lon", "mlon").alias("lon"))
