"""Breadth-first search over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import shared_table
from lodestar.operators.windows import ordered_ranks


def reach(edges: DataFrame, start: DataFrame, depth: int, relevant: DataFrame | None = None) -> DataFrame:
    """(node, depth) of all nodes within `depth` steps of the start nodes.

    Each step joins the frontier with the edges and drops what was visited; it ends early on an empty frontier. With `relevant`
    (node), only those nodes are entered.
    """
    edges = shared_table(edges.select("a", "b"), "edges")
    seen = shared_table(start.select("node", F.lit(0).alias("depth")), "seen")
    front = seen
    for step in range(1, depth + 1):
        near = front.join(edges, front.node == edges.a).select(F.col("b").alias("node")).distinct()
        near = near if relevant is None else near.join(relevant.select("node"), "node", "left_semi")
        front = shared_table(near.join(seen, "node", "left_anti").select("node", F.lit(step).alias("depth")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def frontier(edges: DataFrame, start: DataFrame, counted: DataFrame, bound: int) -> DataFrame:
    """The visits of a first-in first-out queue with an exact bound: (node, parent, number, depth, counted, status).

    Nodes leave the queue in order of entry; a node of `counted` (node) counts towards the bound and sends its links
    (edges a, place, b) to the queue in order of their place, another is visited only. Once `bound` counted nodes have been
    visited the queue stands still: what waits in it has the status not_visited_due_bound and no number; the rest is visited.
    A node that waits several times is visited at its first turn.

    Queue order is depth first of all, then the parent's number, then the link's place, so a depth is one join and one
    global order by sampled ranges; the last counted node within the bound is found by a second order of the counted ones. The
    driver sees counts and one number a depth.
    """
    edges = shared_table(edges.select("a", "place", "b"), "links")
    counted = shared_table(counted.select("node").distinct().withColumn("counted", F.lit(True)), "counted")
    level = start.select("node", F.lit(None).cast(start.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("turn"), F.col("place").cast("long").alias("place"))
    done, visited, found, depth = None, 0, 0, 0
    while True:
        first = level.groupBy("node").agg(F.min(F.struct("turn", "place", "parent")).alias("x")).select("node", "x.*")
        if done is not None:
            first = first.join(done.select("node"), "node", "left_anti")
        ranked = ordered_ranks(first, [], [F.asc("turn"), F.asc("place"), F.asc("node")], "nth")
        own = ranked.join(counted, "node", "left").select("node", "parent", (F.col("nth") + visited).cast("long").alias("number"), F.lit(depth).alias("depth"), F.coalesce("counted", F.lit(False)).alias("counted"))
        own = shared_table(own, "depth")
        size = own.agg(F.count("*").alias("all"), F.count_if("counted").alias("some")).first()
        last = None
        if found + size.some >= bound:
            # The queue stands still after this number; with a bound of none, before the first.
            rank = ordered_ranks(own.filter("counted"), [], [F.asc("number")], "k").filter(F.col("k") == bound - found).first() if bound > found else None
            last = rank.number if rank else visited
        seen = own if last is None else own.filter(F.col("number") <= last)
        done = seen if done is None else done.unionByName(seen)
        level = seen.filter("counted").join(edges, F.col("node") == edges.a).select(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("number").alias("turn"), F.col("place").cast("long").alias("place"))
        if last is not None:
            waits = own.filter(F.col("number") > last).select("node", "parent", "depth", "counted")
            later = level.groupBy("node").agg(F.min(F.struct("turn", "place", "parent")).alias("x")).select("node", "x.parent", F.lit(depth + 1).alias("depth"))
            later = later.join(done.select("node"), "node", "left_anti").join(waits.select("node"), "node", "left_anti").join(counted, "node", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
            rest = waits.unionByName(later).select("node", "parent", F.lit(None).cast("long").alias("number"), "depth", "counted", F.lit("not_visited_due_bound").alias("status"))
            return done.withColumn("status", F.lit("visited")).unionByName(rest)
        if not size.all:
            return done.withColumn("status", F.lit("visited"))
        found, visited, depth = found + size.some, visited + size.all, depth + 1
        done = shared_table(done, "done")
