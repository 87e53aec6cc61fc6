"""Rankings of call graph nodes, their related methods, and shortest paths to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _Levels, follow, strong_components
from .steps import met, step

#: Fixed value: how many nodes and related methods a ranking shows.
RANK_LIMIT = 10


def _related(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(module, node, related, method, n): each node's distinct related nodes with their method and raw edges."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    pairs = edges.groupBy("module", F.col(a).alias("node"), F.col(b).alias("related")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(nodes.select("module", F.col("node").alias("related"), "method"), ["module", "related"])


def degrees(edges: DataFrame, nodes: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct related nodes, their distinct methods, and raw edges of every node that has any."""
    counts = (F.count(F.lit(1)).alias("related_nodes"), F.count_distinct("method").alias("related_methods"), F.sum("n").alias("raw_edges"))
    return _related(edges, nodes, direction).groupBy("module", "node").agg(*counts)


def top_ranked(edges: DataFrame, nodes: DataFrame, direction: str = "out", n: int = RANK_LIMIT) -> DataFrame:
    """Each module's nodes by related nodes, related methods and raw edges, most first, then by node."""
    w = Window.partitionBy("module").orderBy(F.desc("related_nodes"), F.desc("related_methods"), F.desc("raw_edges"), "node")
    return degrees(edges, nodes, direction).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def related_methods(edges: DataFrame, nodes: DataFrame, ranked: DataFrame, direction: str = "out", n: int = RANK_LIMIT) -> DataFrame:
    """Of each ranked node (module, node), its related methods with most nodes, and these nodes in order."""
    groups = _related(edges, nodes, direction).join(ranked.select("module", "node"), ["module", "node"], "left_semi")
    groups = groups.groupBy("module", "node", "method").agg(F.count(F.lit(1)).alias("related_nodes"), F.array_sort(F.collect_list("related")).alias("nodes"))
    w = Window.partitionBy("module", "node").orderBy(F.desc("related_nodes"), "method")
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- fixed values: the kinds of nodes that paths begin at, in order -----------------------------------------------------
ROOT_KINDS = ["DECLARED_ENTRYPOINT", "FAKE_ROOT", "FAKE_WORLD_CLINIT"]
# ---------------------------------------------------------------------------------------------------------------------


def path_roots(nodes: DataFrame) -> DataFrame:
    """(module, node, root_kind) of the declared entry points of ``nodes`` (module, node, is_entrypoint, node_kind) and
    of the synthetic nodes of a kind in ROOT_KINDS."""
    kind = F.when(F.col("is_entrypoint"), ROOT_KINDS[0]).when(F.col("node_kind").isin(*ROOT_KINDS[1:]), F.col("node_kind"))
    return nodes.select("module", "node", kind.alias("root_kind")).where("root_kind IS NOT NULL").distinct()


def shortest_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """(module, root_kind, root, target, distance, path, cycles): the shortest path from each root to each target.

    ``roots`` (module, node, root_kind), ``targets`` (module, node).  Distances come from a reverse walk of all targets
    at once; then each path takes, of the successors that are one step nearer, the smallest.  ``cycles`` tells of every
    step whether its node is on a cycle of the whole graph.  Roots that do not reach a target have no path to it.
    """
    links = step(edges.select("module", "src", "dst").distinct())
    on = ["module", "target", "node"]
    levels = _Levels(targets.select("module", F.col("node").alias("target"), "node", F.lit(0).alias("distance")).distinct())
    while not levels.last.isEmpty():
        above = levels.last.withColumnRenamed("node", "dst").join(links, ["module", "dst"]).select("module", "target", F.col("src").alias("node"), (F.col("distance") + 1).alias("distance")).distinct()
        levels.add(above.join(levels.all(), on, "left_anti"))
    near = levels.all()
    nearer = near.select("module", "target", F.col("node").alias("dst"), (F.col("distance") + 1).alias("distance"))
    pointers = step(near.join(links.withColumnRenamed("src", "node"), ["module", "node"]).join(met(nearer), ["module", "target", "dst", "distance"]).groupBy(*on).agg(F.min("dst").alias("next")))
    started = step(near.join(roots.select("module", "node", "root_kind"), ["module", "node"]))
    paths = step(follow(pointers, started, ["module", "target"]))
    cyclic = strong_components(links).where("cyclic").select("module", F.col("node").alias("_at"), F.lit(True).alias("_cycle"))
    steps = paths.select(*on, F.posexplode("path").alias("_pos", "_at")).join(met(cyclic), ["module", "_at"], "left")
    flags = steps.groupBy(*on).agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_cycle", F.lit(False)).alias("c")))), lambda x: x["c"]).alias("cycles"))
    return started.join(met(paths), on).join(met(flags), on).select("module", "root_kind", F.col("node").alias("root"), "target", "distance", "path", "cycles")
