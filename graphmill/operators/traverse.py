"""Paths and cycles over edges, by frontiers that grow one step a round."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored


def _links(edges: DataFrame, directed: bool) -> DataFrame:
    links = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src is not null and dst is not null")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.distinct()


def shortest_path(edges: DataFrame, start: str, goal: str, directed: bool = False) -> list[str] | None:
    """The nodes of a shortest path between two nodes, of several the one with the least ids seen from its end; None without one.

    Frontiers grow from the start and remember the least node they came from. The search ends at the goal or when nothing
    new is reached; only the path itself, one id a step, comes to the driver.
    """
    links = _links(edges, directed)
    seen = stored(links.sparkSession.createDataFrame([(start, None)], "node string, came string"), "seen")
    front, layers = seen, [seen]
    while front.where(F.col("node") == goal).isEmpty():
        reached = front.select(F.col("node").alias("src")).join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("came"))
        known = reduce(DataFrame.unionByName, [layer.select("node") for layer in layers])
        front = stored(reached.join(known, "node", "left_anti"), "seen")
        if front.isEmpty():
            return None
        layers.append(front)
    path = [goal]
    for layer in reversed(layers[1:]):
        path.append(layer.where(F.col("node") == path[-1]).first().came)
    return path[::-1]


def distances(edges: DataFrame, start: DataFrame, most_steps: int | None = None, directed: bool = True) -> DataFrame:
    """Shortest distance of each node from the start set: `node, steps`, up to `most_steps` if given.

    A round joins only the nodes found last with the edges and keeps what is new, so that no pair of nodes is ever
    built and a hub is visited once.
    """
    links = _links(edges, directed)
    seen = cut(start.select(F.col("node"), F.lit(0).alias("steps")).distinct())
    front = seen
    for step in count(1) if most_steps is None else range(1, most_steps + 1):
        reached = front.select(F.col("node").alias("src")).join(links, "src").select(F.col("dst").alias("node")).distinct()
        front = cut(reached.join(seen, "node", "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen
