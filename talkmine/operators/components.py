"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmine.functions.ranking import skew_join
from talkmine.session import stored

#: components that may be sent to every task
SMALL = 100_000


def _with_lowest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with ``low``, the least of u and all its v.

    The minima are stored first, so that the join reads two plain shuffles and a hub's partition
    can be split among tasks.
    """
    low = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")))
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller end."""
    found = _with_lowest(edges)
    return found.select(F.explode(F.array(
        F.struct(F.col("u"), F.col("low").alias("v")),
        F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges``, a table of two columns of one type.

    The component is the least node that can be reached. Rounds go on until nothing moves; their
    number grows with the logarithm of the nodes. Loops and null ends are left out, so a node
    that has only these doesn't appear. Each round is stored, so that neither plans nor guessed sizes grow.
    """
    a, b = edges.columns
    edges = edges.filter(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = stored(_small_star(_large_star(edges)).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def merged(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of ``known``, a table of that kind, after new ``edges`` are added to it.

    Stars run on the components that new edges touch, not on their members. Of the known nodes only
    those of components that moved change, which are told by the few rows that name these.
    """
    a, b = edges.columns
    ends = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").distinct())
    at = stored(ends.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(known, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("fresh")))
    roots = ends
    for side in ("x", "y"):
        roots = roots.join(at.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side)
    moved = connected(roots.select("of_x", "of_y")).filter("node <> component")
    moved = stored(moved.select(F.col("node").alias("component"), F.col("component").alias("to")))
    nodes = known.unionByName(at.filter("fresh").select("node", "component"))
    sizes = nodes.join(moved.select("component"), "component", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    changed = skew_join(nodes, moved.join(sizes, "component"), "component", "n").select("node", F.col("to").alias("component"))
    few = moved.select("component")
    same = nodes.join(F.broadcast(few) if few.count() <= SMALL else few, "component", "left_anti")
    return same.select("node", "component").unionByName(changed)
