"""Connected components of a distributed edge list, without any part of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star or small-star step over edges (a > b), which are deleted."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        sides = sides.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = sides.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        moved = moved.where("a <> b")
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return materialize(moved.distinct(), "edges", [edges, least])


def components(edges: DataFrame, replaces: list[DataFrame] = ()) -> DataFrame:
    """(node, component) of every node that has an edge; a component's name is its smallest node.

    ``edges`` has columns a and b (any order, repeats and loops allowed).  Alternates large-star and small-star steps
    until the edges are stars; a node of high degree only meets map-side minima and joins that Spark can split.  The
    steps in ``replaces`` are deleted when ``edges`` has been read.
    """
    current = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", replaces)
    seen = None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        current = _stars(_stars(current, small=False), small=True)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return materialize(current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components", [current])
