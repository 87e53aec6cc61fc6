"""Normalised dependency facts: selected trees, occurrences, classpath rows and changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach, reached, validate_occurrence_graph
from .steps import forget, met, step

#: Nodes that may look at one node through an exchange; those that more look at are at most the nodes by this number.
HOT = 50_000
#: Scopes that a selected tree retains.
RETAINED = ["compile", "runtime", "provided", "system"]


def selected_tree(nodes: DataFrame, retained: list[str] = RETAINED) -> DataFrame:
    """(module, node, parent): subtrees of other scopes are dropped, reactor nodes give their place to their children.

    nodes: module, node, parent (null for the root), ord, scope, reactor.  The root stays whatever it is; what hangs on
    a node that is not there, or on a circle, goes.  Every node looks up twice as far in each round, over all modules at once: whether
    anything it has passed is dropped, and the nearest node there that keeps its place.
    """
    rows = nodes.select("module", "node", "parent", F.col("parent").isNull().alias("root"), (F.col("parent").isNotNull() & ~F.coalesce(F.col("scope").isin(*retained), F.lit(False))).alias("bad"), F.coalesce("reactor", F.lit(False)).alias("reactor"))
    above = rows.select("module", F.col("node").alias("parent"), F.col("bad").alias("_bad"), (F.col("root") | ~F.col("reactor")).alias("_stays"), F.col("parent").alias("_up"))
    joined = rows.join(met(above), ["module", "parent"], "left")
    lost = F.col("parent").isNotNull() & F.col("_bad").isNull()
    state = step(joined.select("module", "node", "root", "reactor", (F.col("bad") | lost | F.coalesce("_bad", F.lit(False))).alias("bad"), F.when(F.col("_stays"), F.col("parent")).alias("near"), F.when(~lost, F.col("parent")).alias("far")))
    for _ in range(64):  # twice as far each time: what has still not met a root then is on a circle of parents
        if state.where("far IS NOT NULL").isEmpty():
            break
        there = state.select("module", F.col("node").alias("far"), F.col("bad").alias("_bad"), F.col("near").alias("_near"), F.col("far").alias("_far"))
        # towards the end most nodes look at a few: those few are sent to every task, the others are met by a merge join
        looking = state.where("far IS NOT NULL")
        hot = step(looking.groupBy("module", "far").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select("module", "far"))
        few = step(there.join(F.broadcast(hot), ["module", "far"], "left_semi"))
        at_few = looking.join(F.broadcast(few), ["module", "far"])
        others = looking.join(F.broadcast(hot), ["module", "far"], "left_anti").join(met(there), ["module", "far"], "left")
        names = ["module", "node", "root", "reactor", "bad", "near", "_bad", "_near", "_far"]
        ended = state.where("far IS NULL").select("module", "node", "root", "reactor", "bad", "near")
        further = at_few.select(*names).union(others.select(*names)).unionByName(ended, allowMissingColumns=True)
        doubled = step(further.select("module", "node", "root", "reactor", (F.col("bad") | F.coalesce("_bad", F.lit(False))).alias("bad"), F.coalesce("near", "_near").alias("near"), F.col("_far").alias("far")))
        forget(state, hot, few)
        state = doubled
    return state.where("root OR NOT (bad OR reactor OR far IS NOT NULL)").select("module", "node", F.when(~F.col("root"), F.col("near")).alias("parent"))


def normalised_occurrences(raw: DataFrame, winners: DataFrame, retained: list[str] = RETAINED) -> tuple[DataFrame, DataFrame]:
    """Raw nodes with their key's winning version, and those whose key has no winner (none may be left).

    raw: module_key, node, parent (null for the root), scope, group_id, artifact_id.  Nodes of other scopes go with all
    that hangs on them.
    """
    gone = reach(raw.where("parent IS NOT NULL").select(F.struct("module_key", F.col("parent").alias("node")).alias("src"), F.struct("module_key", "node").alias("dst")), raw.where(F.col("parent").isNotNull() & ~F.col("scope").isin(*retained)).select(F.struct("module_key", "node").alias("node")))
    kept = raw.join(gone.select("node.module_key", "node.node").distinct(), ["module_key", "node"], "left_anti")
    joined = kept.join(winners.select("module_key", "group_id", "artifact_id", F.col("version").alias("winning_version")), ["module_key", "group_id", "artifact_id"], "left")
    return joined.where("winning_version IS NOT NULL"), joined.where("winning_version IS NULL").drop("winning_version")


def classpath_rows(rows: DataFrame, by: list[str], identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity, numbered from 0 without a gap."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, *identity).orderBy(*order))).where("_rn = 1").drop("_rn")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def changed_path_bodies(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """External nodes, but the root, on a path to a changed artifact have REAL_IR bodies, the others NO_OP."""
    on = paths.select(F.explode("path").alias("node")).distinct().withColumn("_on", F.lit(True))
    external = nodes.where(~F.col("reactor") & ~F.col("is_root"))
    return external.join(on, "node", "left").select("node", F.when(F.col("_on"), "REAL_IR").otherwise("NO_OP").alias("body"))


def dependency_scopes(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(module, node, body, mode, reason) of the external nodes of every module.

    nodes: module, node, is_root, reactor; seeds: module, node.  CHANGED_PATHS gives a body to nodes on a path from the
    root to a seed; a module falls back to FULL, with every body, if its graph is not valid or has not every seed.
    """
    problems = validate_occurrence_graph(nodes.select("module", "node", "is_root"), edges)
    lacking = seeds.join(met(nodes.select("module", "node")), ["module", "node"], "left_anti").select("module").distinct().withColumn("_lacking", F.lit("SEED_MISSING"))
    state = problems.join(lacking, "module", "left").select("module", F.coalesce("problem", "_lacking").alias("reason"))
    state = step(state)  # a row for each module
    usable = seeds.join(state.where("reason IS NULL"), "module", "left_semi")
    on = reached(edges, usable, ("module",), reverse=True).withColumn("_on", F.lit(True))
    external = nodes.where(~F.col("reactor") & ~F.col("is_root")).select("module", "node").join(state, "module").join(met(on), ["module", "node"], "left")
    full = F.col("reason").isNotNull()
    return external.select("module", "node", F.when(full | F.col("_on"), "REAL_IR").otherwise("NO_OP").alias("body"), F.when(full, "FULL").otherwise("CHANGED_PATHS").alias("mode"), "reason")
