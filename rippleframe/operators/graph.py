"""Graph operators: reachability, first-discoverer paths, components, validation, call graphs.

Modules are independent graphs.  Everything that may be as large as a module is set-based: a level or a round is one
join, written as a step of its own.  A group at a time is worked on only where its size is known to be small: the
occurrence graphs of one document each, and for components the modules of at most ``SMALL_MODULE`` edges and nodes,
which are counted first; both ways are exact.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .places import pairs_by_runs
from .steps import forget, met, step

#: Edges and nodes of a module whose components one task finds (a few MB).
SMALL_MODULE = 200_000


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """(seed, node, level): every node that a seed reaches over (src, dst), and its distance.

    One frontier for all seeds, a level at a time; each level is an equi-join and an anti-join with what is known.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = step(edges.select(F.col(a).alias("node"), F.col(b).alias("_next")).distinct())
    levels = _Levels(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("level")).distinct())
    for level in count(1):
        levels.add(levels.last.join(steps, "node").select("seed", F.col("_next").alias("node")).distinct().join(levels.all(), ["seed", "node"], "left_anti").withColumn("level", F.lit(level)))
        if levels.last.isEmpty():
            return levels.all()


def simple_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every simple path from a seed to a node without predecessors, as (seed, path); for small graphs.

    Paths grow by one caller in each round until none can; a node that is on a path already ends it.
    """
    callers = edges.select(F.col("dst").alias("node"), F.col("src").alias("_caller")).distinct()
    open_paths = step(seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("path")).distinct())
    ended = []
    while not open_paths.isEmpty():
        ended.append(step(open_paths.join(callers.select("node"), "node", "left_anti").select("seed", "path")))
        longer = open_paths.join(callers, "node").where(~F.array_contains("path", F.col("_caller")))
        open_paths = step(longer.select("seed", F.col("_caller").alias("node"), F.array_prepend("path", F.col("_caller")).alias("path")))
    return reduce(DataFrame.union, ended) if ended else open_paths.select("seed", "path")


def _adjacency(pdf: pd.DataFrame, reverse: bool) -> dict:
    out: dict = {}
    a, b = ("dst", "src") if reverse else ("src", "dst")
    for x, y in sorted(set(zip(pdf[a].tolist(), pdf[b].tolist(), strict=True))):
        out.setdefault(x, []).append(y)
    return out


def reverse_paths(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, pruned: DataFrame | None = None) -> DataFrame:
    """(module, seed, node, level, next): breadth-first callers of each seed; ``next`` is the first discoverer.

    Callers are visited in the order of (method, node) of ``nodes`` (module, node, method, synthetic), or of the node
    alone; synthetic nodes and the edges in ``pruned`` (module, caller_id, callee_id) are passed over.  The queue's order
    is a number: a level's nodes stand in the order of (number of the discoverer, method, node), which a range sort of
    the level turns into their own numbers.  A node's first discoverer is the one with the least number.
    """
    steps = edges.select("module", F.col("dst").alias("node"), F.col("src").alias("_caller")).distinct()
    if pruned is not None:
        steps = steps.join(met(pruned.select("module", F.col("caller_id").alias("_caller"), F.col("callee_id").alias("node")).distinct()), ["module", "_caller", "node"], "left_anti")
    if nodes is None:
        steps = steps.withColumn("_method", F.lit(""))
    else:
        known = nodes.where("NOT synthetic").select("module", F.col("node").alias("_caller"), F.col("method").alias("_method"))
        steps = steps.join(met(known), ["module", "_caller"])
    steps = step(steps)
    columns = ["module", "seed", "node", "level", "next", "_number"]
    levels = _Levels(seeds.select("module", F.col("node").alias("seed"), "node", F.lit(0).alias("level"), F.lit(None).cast(seeds.schema["node"].dataType).alias("next"), F.lit(0).cast("long").alias("_number")).distinct())
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in count(1):
        first = F.min(F.struct("_number", "node")).alias("_first")
        callers = levels.last.join(steps, ["module", "node"]).groupBy("module", "seed", "_caller").agg(first, F.first("_method").alias("_method")).withColumnRenamed("_caller", "node")
        new = step(callers.join(levels.all(), ["module", "seed", "node"], "left_anti"))
        order = ["module", "seed", "_first._number", "_method", "node"]
        numbered = new.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_number", F.monotonically_increasing_id())
        levels.add(numbered.select("module", "seed", "node", F.lit(level).alias("level"), F.col("_first.node").alias("next"), "_number").select(*columns))
        forget(new)
        if levels.last.isEmpty():
            return levels.all().drop("_number")


def follow(pointers: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, path): the nodes from each start (*keys, node) along ``pointers`` (*keys, node, next) to their end.

    A round moves all starts by one pointer and writes only the nodes it has reached; paths are put together once.
    """
    ahead = pointers.where("next IS NOT NULL").select(*keys, F.col("node").alias("_at"), "next")
    levels = _Levels(starts.select(*keys, "node", F.col("node").alias("_at"), F.lit(0).alias("_hop")).distinct())
    while not levels.last.isEmpty():
        levels.add(levels.last.join(ahead, [*keys, "_at"]).select(*keys, "node", F.col("next").alias("_at"), (F.col("_hop") + 1).alias("_hop")))
    hops = F.sort_array(F.collect_list(F.struct("_hop", "_at")))
    return levels.all().groupBy(*keys, "node").agg(F.transform(hops, lambda x: x["_at"]).alias("path"))


def _kind(rows: DataFrame) -> str:
    return rows.schema["module"].dataType.simpleString()


def _strong(adjacency: dict, nodes) -> dict:
    """Node to the smallest node of its strongly connected component (iterative)."""
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack: list = []
    out: dict = {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(adjacency.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, it = work[-1]
            step = next(it, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    out.update(dict.fromkeys(members, min(members)))
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                on.add(step)
                work.append((step, iter(adjacency.get(step, ()))))
            elif step in on:
                low[node] = min(low[node], index[step])
    return out


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(module, node, component, size, cyclic); a component's name is its smallest node.

    ``nodes`` (module, node) adds nodes without edges.  Modules are counted: small ones are solved in a task each, the
    others by rounds of joins.
    """
    rows = edges.select("module", "src", "dst", F.lit(True).alias("edge")).distinct()
    if nodes is not None:
        rows = rows.union(nodes.select("module", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(False)).distinct())
    rows = step(rows)
    large = step(rows.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_MODULE).select("module"))
    if large.isEmpty():
        return _small_components(rows)
    inside = rows.join(large, "module", "left_semi")
    found = _large_components(inside.where("edge").select("module", "src", "dst"), inside.select("module", F.col("src").alias("node")))
    return found.unionByName(_small_components(rows.join(large, "module", "left_anti")))


def _small_components(rows: DataFrame) -> DataFrame:
    """Modules one after the other in their order: a task holds one module at a time, and thousands cost one call."""

    def solve(module, src, dst, edge):
        forward: dict = {}
        for x, y, e in zip(src, dst, edge, strict=True):
            if e:
                forward.setdefault(x, []).append(y)
        nodes = sorted(set(src) | set(dst))
        comp = _strong(forward, nodes)
        size = Counter(comp.values())
        return [(module, n, comp[n], size[comp[n]], size[comp[n]] > 1 or n in forward.get(n, ())) for n in nodes]

    names = ["module", "node", "component", "size", "cyclic"]
    schema = f"module {_kind(rows)}, node long, component long, size long, cyclic boolean"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def table(found):
        return pa.RecordBatch.from_pydict(dict(zip(names, zip(*found, strict=True), strict=True)), schema=types)

    def solve_all(batches):
        here, held, found = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("module", "src", "dst", "edge")), strict=True):
                if held is None or row[0] != here:
                    if held is not None:
                        found += solve(here, *held)
                        if len(found) >= 20_000:
                            yield table(found)
                            found = []
                    here, held = row[0], ([], [], [])
                for column, value in zip(held, row[1:], strict=True):
                    column.append(value)
        if held is not None:
            yield table(found + solve(here, *held))

    return rows.repartition("module").sortWithinPartitions("module").mapInArrow(solve_all, schema)


def _large_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by rounds.  Nodes without a live predecessor or successor are components by themselves and go first.  Of
    the rest, every node learns the smallest node that reaches it; where that is the node itself, what reaches it back
    among the nodes of the same name is its component.  Rounds go on until no node is left.
    """
    key = ["module", "node"]
    pairs = edges.select("module", "src", "dst").distinct()
    loops = pairs.where("src = dst").select("module", F.col("src").alias("node"), F.lit(True).alias("_loop"))
    ends = pairs.select("module", F.col("src").alias("node")).union(pairs.select("module", F.col("dst").alias("node")))
    live = step(ends.union(nodes.select(*key)).distinct())
    links = step(pairs.where("src <> dst"))
    settled = []

    def within(links, live):
        kept = links.join(met(live.select("module", F.col("node").alias("src"))), ["module", "src"], "left_semi")
        return step(kept.join(met(live.select("module", F.col("node").alias("dst"))), ["module", "dst"], "left_semi").select("module", "src", "dst"))

    while not live.isEmpty():
        while True:
            inner = live.join(met(links.select("module", F.col("dst").alias("node")).distinct()), key, "left_semi").join(met(links.select("module", F.col("src").alias("node")).distinct()), key, "left_semi")
            inner = step(inner)
            gone = step(live.join(met(inner), key, "left_anti"))
            if gone.isEmpty():
                break
            settled.append(gone.withColumn("component", F.col("node")))
            live, links = inner, within(links, inner)
        if live.isEmpty():
            break
        named = step(live.withColumn("_least", F.col("node")))
        fresh = named
        while not fresh.isEmpty():
            sent = fresh.withColumnRenamed("node", "src").join(met(links), ["module", "src"]).groupBy("module", F.col("dst").alias("node")).agg(F.min("_least").alias("_sent"))
            fresh = step(sent.join(met(named), key).where("_sent < _least").select(*key, F.col("_sent").alias("_least")))
            changed = named.join(met(fresh.withColumnRenamed("_least", "_new")), key, "left")
            named = step(changed.select(*key, F.coalesce("_new", "_least").alias("_least")))
        back = step(named.where("node = _least"))
        members = back
        alike = links.join(met(named.select("module", F.col("node").alias("src"), F.col("_least").alias("_a"))), ["module", "src"]).join(met(named.select("module", F.col("node").alias("dst"), F.col("_least").alias("_b"))), ["module", "dst"])
        alike = step(alike.where("_a = _b").select("module", "src", "dst", F.col("_a").alias("_least")))
        while not back.isEmpty():
            before = back.withColumnRenamed("node", "dst").join(met(alike), ["module", "dst", "_least"]).select("module", F.col("src").alias("node"), "_least").distinct()
            back = step(before.join(met(members), [*key, "_least"], "left_anti"))
            members = step(members.union(back))
        settled.append(members.select(*key, F.col("_least").alias("component")))
        live = step(live.join(met(members), key, "left_anti"))
        links = within(links, live)
    if not settled:
        found = live.withColumn("component", F.col("node"))
    else:
        found = reduce(DataFrame.union, settled)
    sizes = found.groupBy("module", "component").agg(F.count(F.lit(1)).alias("size"))
    out = found.join(met(sizes), ["module", "component"]).join(met(loops), key, "left")
    return out.select("module", "node", "component", "size", ((F.col("size") > 1) | F.coalesce("_loop", F.lit(False))).alias("cyclic"))


def reached(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = (), reverse: bool = False) -> DataFrame:
    """(*keys, node): what any of ``seeds`` (*keys, node) reaches over ``edges`` (*keys, src, dst), the seeds included.

    Nodes alone are carried, and each level is a step of its own: a node is met once, however many seeds lead to it.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    on = [*keys, "node"]
    steps = step(edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("_next")).distinct())
    levels = _Levels(seeds.select(*on).distinct())
    while not levels.last.isEmpty():
        levels.add(levels.last.join(steps, on).select(*keys, F.col("_next").alias("node")).distinct().join(levels.all(), on, "left_anti"))
    return levels.all()


class _Levels:
    """The levels of a walk, each written once; eight of a size become one, so what is read stays a short union.

    Both are met by merge joins: a broadcast in every round would send each level through the driver.
    """

    def __init__(self, first: DataFrame):
        self._pieces: list[tuple[int, DataFrame]] = []
        self.add(first)

    def add(self, level: DataFrame) -> None:
        written = step(level)
        self.last = written.hint("merge")
        self._pieces.append((0, written))
        while len(self._pieces) >= 8 and self._pieces[-8][0] == self._pieces[-1][0]:
            tier, merged = self._pieces[-1][0] + 1, step(reduce(DataFrame.union, [x for _, x in self._pieces[-8:]]))
            if any(x is written for _, x in self._pieces[-8:]):
                old, self._pieces[-8:] = self._pieces[-8:-1], [(tier, merged)]
                forget(*(x for _, x in old))

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, [x for _, x in self._pieces]).hint("merge")


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(module, src, dst): distinct edges between different components, named by their smallest nodes."""
    of = components.select("module", "node", "component")
    inner = edges.join(met(of.withColumnsRenamed({"node": "src", "component": "_a"})), ["module", "src"]).join(met(of.withColumnsRenamed({"node": "dst", "component": "_b"})), ["module", "dst"])
    return inner.where("_a <> _b").select("module", F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()


def source_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Components that no edge enters from outside."""
    entered = condensation(edges, components).select("module", F.col("dst").alias("component")).distinct()
    return components.select("module", "component", "size", "cyclic").groupBy("module", "component").agg(F.max("size").alias("size"), F.bool_or("cyclic").alias("cyclic")).join(met(entered), ["module", "component"], "left_anti")


def traced_edges(edges: DataFrame, nodes: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """(module, src, dst): the calls that a reverse walk follows: without synthetic callers and without ``pruned``
    (module, caller_id, callee_id)."""
    kept = edges.select("module", "src", "dst").distinct()
    if pruned is not None:
        kept = kept.join(met(pruned.select("module", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")).distinct()), ["module", "src", "dst"], "left_anti")
    return kept.join(met(nodes.where("NOT synthetic").select("module", F.col("node").alias("src"))), ["module", "src"], "left_semi")


def seed_roots(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """(module, seed, component, root, root_method, cycle): the impact roots of every seed.

    ``edges`` (module, src, dst) is the whole call graph, ``nodes`` has module, node, method, origin, is_entrypoint and
    synthetic, ``seeds`` module and node.  A seed's trace is all that reaches it over ``traced_edges``.  A trace holds
    every caller of its nodes, so it is a union of whole components of the module, and what enters a component is the
    same in every trace: components and their sources are found once, and a seed only decides which of them it sees.
    A root is the least entry point of a source component with PROJECT nodes, else its least PROJECT node, by (method,
    node).  A component that is no cycle goes for a seed whose trace has a PROJECT node of the root's method with a
    caller.  Repeated seeds count once; seeds without callers are their own trace.
    """
    graph = step(traced_edges(edges, nodes, pruned))
    seeds = seeds.select("module", "node").distinct()
    components = step(strong_components(graph, nodes.select("module", "node").union(seeds)))
    links = step(condensation(graph, components))
    own = components.join(met(nodes.where("origin = 'PROJECT'").select("module", "node", "method", "is_entrypoint")), ["module", "node"])
    sources = own.join(met(links.select("module", F.col("dst").alias("component")).distinct()), ["module", "component"], "left_anti")
    least = F.min(F.struct(~F.col("is_entrypoint"), F.col("method"), F.col("node"))).alias("r")
    roots = sources.groupBy("module", "component").agg(least, F.bool_or("cyclic").alias("cycle"))
    roots = step(roots.select("module", "component", F.col("r.node").alias("root"), F.col("r.method").alias("root_method"), "cycle"))
    # where a method that is the root of no cycle has a caller, and whether a seed sees that place
    asked = roots.where("NOT cycle").select("module", F.col("root_method").alias("method")).distinct()
    called = own.join(met(graph.select("module", F.col("dst").alias("node")).distinct()), ["module", "node"], "left_semi").join(met(asked), ["module", "method"]).select("module", "component", F.col("method").alias("root_method")).distinct()
    placed = step(seeds.join(met(components.select("module", "node", "component")), ["module", "node"]).select("module", F.col("node").alias("seed"), F.col("component").alias("goal")))
    # only components on a way to a root or a called method matter, and seeds of one component share a walk
    ends = roots.select("module", F.col("component").alias("node")).union(called.select("module", F.col("component").alias("node")))
    useful = reached(links, ends, ("module",))
    steps = links.join(useful.withColumnRenamed("node", "src"), ["module", "src"], "left_semi").select("module", F.col("dst").alias("component"), F.col("src").alias("_above"))
    on = ["module", "goal", "component"]
    goals = placed.select("module", "goal", F.col("goal").alias("component")).distinct()
    levels = _Levels(goals.join(useful.withColumnRenamed("node", "component"), ["module", "component"], "left_semi").select(*on))
    while not levels.last.isEmpty():
        above = levels.last.join(steps, ["module", "component"]).select("module", "goal", F.col("_above").alias("component")).distinct()
        levels.add(above.join(levels.all(), on, "left_anti"))
    seen = levels.all()
    found = seen.join(met(roots), ["module", "component"])
    elsewhere = seen.join(met(called), ["module", "component"]).select("module", "goal", "root_method").distinct()
    kept = found.where("cycle").select(*on, "root", "root_method", "cycle").union(found.where("NOT cycle").join(met(elsewhere), ["module", "goal", "root_method"], "left_anti").select(*on, "root", "root_method", "cycle"))
    return placed.join(met(kept), ["module", "goal"]).select("module", "seed", "component", "root", "root_method", "cycle")


def impact_roots(edges: DataFrame, components: DataFrame, nodes: DataFrame) -> DataFrame:
    """G10 of one trace: (module, component, root, root_method, cycle) of the source components that hold PROJECT nodes.

    ``edges`` and ``nodes`` are those of a single seed's trace in each module; several seeds go to ``seed_roots``.

    The root is an entry point if there is one, else any PROJECT node, the least by (method, node).  A component that is
    no cycle goes if its root's method is called elsewhere: if another PROJECT node of that method has a predecessor.
    ``nodes`` has module, node, method, origin, is_entrypoint.
    """
    own = nodes.where("origin = 'PROJECT'").select("module", "node", "method", "is_entrypoint")
    called = own.join(met(edges.select("module", F.col("dst").alias("node")).distinct()), ["module", "node"], "left_semi").select("module", F.col("method").alias("root_method")).distinct()
    components = step(components)
    project = components.join(met(own), ["module", "node"])
    chosen = project.join(met(source_components(edges, components).select("module", "component")), ["module", "component"], "left_semi")
    least = F.min(F.struct(~F.col("is_entrypoint"), F.col("method"), F.col("node"))).alias("r")
    roots = chosen.groupBy("module", "component").agg(least, F.bool_or("cyclic").alias("cycle")).select("module", "component", F.col("r.node").alias("root"), F.col("r.method").alias("root_method"), "cycle")
    return roots.where("cycle").union(roots.where("NOT cycle").join(met(called), ["module", "root_method"], "left_anti").select(*roots.columns))


def root_paths(reverse: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, seed, root_method, root, path, classification, root_kind): the path of each root method to each seed.

    ``reverse`` is of ``reverse_paths``, ``roots`` (module, seed, root, root_method, cycle).  Of several roots of one
    method the first in the order of nodes stands; a path is DIRECT if its seed is PROJECT code, else TRANSITIVE.
    """
    known = roots.join(met(reverse.select("module", "seed", F.col("node").alias("root"))), ["module", "seed", "root"], "left_semi")
    kind = F.when(F.col("cycle"), "STRONGLY_CONNECTED_COMPONENT").otherwise("METHOD")
    first = step(known.groupBy("module", "seed", "root_method").agg(F.min(F.struct("root", kind.alias("root_kind"))).alias("r")).select("module", "seed", "root_method", "r.*"))
    paths = follow(reverse.select("module", "seed", "node", "next"), first.select("module", "seed", F.col("root").alias("node")), ["module", "seed"])
    first = first.join(met(paths.withColumnRenamed("node", "root")), ["module", "seed", "root"])
    origin = nodes.select("module", F.col("node").alias("seed"), F.when(F.col("origin") == "PROJECT", "DIRECT").otherwise("TRANSITIVE").alias("classification"))
    return first.join(origin, ["module", "seed"]).select("module", "seed", "root_method", "root", "path", "classification", "root_kind")


def validate_occurrence_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, problem): the first that holds of ROOT_MISSING, MULTIPLE_ROOTS, EDGE_INCOMPLETE, CYCLE, UNREACHABLE, else null.

    Modules of at most ``SMALL_MODULE`` nodes and edges, which are counted first, are checked in a task each, the others
    by joins over all of them.
    """
    sizes = nodes.select("module").union(edges.select("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    large = step(sizes.where(F.col("n") > SMALL_MODULE).select("module"))
    if large.isEmpty():
        return _small_problems(nodes, edges)
    inside = lambda rows: rows.join(large, "module", "left_semi")
    small = lambda rows: rows.join(large, "module", "left_anti").select(*(F.col(c).alias(c) for c in rows.columns))  # noqa: E731  (columns of its own)
    return _large_problems(inside(nodes), inside(edges)).union(_small_problems(small(nodes), small(edges)))


def _large_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by joins.  All that a root reaches is a tree if it has one edge less than nodes; only what has more is
    searched for cycles."""
    known = step(nodes.groupBy("module", "node").agg(F.bool_or(F.coalesce("is_root", F.lit(False))).alias("is_root")))
    links = step(edges.select("module", "src", "dst").distinct())
    modules = known.groupBy("module").agg(F.count_if("is_root").alias("roots"), F.count(F.lit(1)).alias("n"))
    ends = links.select("module", F.col("src").alias("node")).union(links.select("module", F.col("dst").alias("node"))).distinct()
    lacking = step(ends.join(met(known), ["module", "node"], "left_anti").select("module").distinct())
    one = modules.where("roots = 1").join(lacking, "module", "left_anti").select("module")
    seen = step(reached(links, known.where("is_root").join(one, "module", "left_semi").select("module", "node"), ("module",)))
    among = links.join(met(seen.withColumnRenamed("node", "src")), ["module", "src"], "left_semi")
    counts = seen.groupBy("module").agg(F.count(F.lit(1)).alias("seen")).join(among.groupBy("module").agg(F.count(F.lit(1)).alias("links")), "module", "left")
    counts = step(counts)
    doubtful = counts.where("links >= seen").select("module")
    if doubtful.isEmpty():
        cyclic = doubtful
    else:
        cyclic = strong_components(among.join(doubtful, "module", "left_semi")).where("cyclic").select("module").distinct()
    told = lambda rows, name: rows.select("module", F.lit(True).alias(name))
    facts = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [told(links, "edges"), modules, counts, told(lacking, "lacking"), told(cyclic, "cyclic")])
    state = facts.groupBy("module").agg(*(F.max(c).alias(c) for c in ("roots", "n", "seen", "lacking", "cyclic")))
    roots = F.coalesce("roots", F.lit(0))
    problem = F.when(roots == 0, "ROOT_MISSING").when(roots > 1, "MULTIPLE_ROOTS").when(F.col("lacking"), "EDGE_INCOMPLETE").when(F.col("cyclic"), "CYCLE").when(F.col("seen") < F.col("n"), "UNREACHABLE")
    return state.select("module", problem.alias("problem"))


def _small_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def check(key, pdf_nodes, pdf_edges):
        known = dict(zip(pdf_nodes["node"].tolist(), pdf_nodes["is_root"].tolist(), strict=True))
        roots = [n for n, r in known.items() if r]
        children = _adjacency(pdf_edges, reverse=False)
        if not roots:
            problem = "ROOT_MISSING"
        elif len(roots) > 1:
            problem = "MULTIPLE_ROOTS"
        elif any(x not in known for x in [*pdf_edges["src"].tolist(), *pdf_edges["dst"].tolist()]):
            problem = "EDGE_INCOMPLETE"
        else:
            seen, queue = {roots[0]}, [roots[0]]
            for n in queue:
                for c in children.get(n, ()):
                    if c not in seen:
                        seen.add(c)
                        queue.append(c)
            comp = _strong({n: children.get(n, []) for n in seen}, sorted(seen))
            cyclic = len(set(comp.values())) < len(comp) or any(n in children.get(n, ()) for n in seen)
            problem = "CYCLE" if cyclic else "UNREACHABLE" if len(seen) < len(known) else None
        return pd.DataFrame([(key[0], problem)], columns=["module", "problem"])

    return nodes.groupBy("module").cogroup(edges.groupBy("module")).applyInPandas(check, f"module {_kind(nodes)}, problem string")


def dispatch_edges(sites: DataFrame, methods: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Candidate call edges: each site's target method in every concrete subtype of the declared owner.

    sites (caller, owner, name, descriptor), methods (node, owner, name, descriptor, concrete), subtypes (sub, super).
    """
    wide = sites.join(subtypes.select(F.col("super").alias("owner"), F.col("sub").alias("_sub")), "owner")
    found = methods.where("concrete").select(F.col("owner").alias("_sub"), "name", "descriptor", F.col("node").alias("dst"))
    return wide.join(found, ["_sub", "name", "descriptor"]).select(F.col("caller").alias("src"), "dst").distinct()


def call_graph(sites: DataFrame, methods: DataFrame, subtypes: DataFrame, entrypoints: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """(src, dst) edges that the entry points reach.

    ``methods`` also has origin and no_op: methods of the JDK and without a body are leaves.  A site whose declared owner
    is JDK code keeps JDK targets alone.  ``providers`` (caller, constructor) adds the constructors that service loading
    gives a caller.  The worklist is a frontier: what it reaches does not depend on its order.  Sites of one shape (owner,
    name, descriptor) have the same targets: the walk goes from methods to shapes and on to targets, so that edges are
    spelled out only in the result.
    """
    shape = F.struct(F.lit("call").alias("by"), "owner", "name", "descriptor")
    shapes = sites.select("owner", "name", "descriptor").distinct().withColumn("caller", shape)
    owners = methods.groupBy("owner").agg(F.max(F.when(F.col("origin") == "JDK", 1).otherwise(0)).alias("_jdk"))
    jdk_only = dispatch_edges(shapes.join(owners.where("_jdk = 1"), "owner", "left_semi"), methods.where("origin = 'JDK'"), subtypes)
    other = dispatch_edges(shapes.join(owners.where("_jdk = 1"), "owner", "left_anti"), methods, subtypes)
    targets = jdk_only.union(other).withColumnRenamed("src", "_shape")
    calls = sites.select(F.col("caller").alias("src"), shape.alias("_shape"))
    if providers is not None:
        own = F.struct(F.lit("provider").alias("by"), F.col("caller").cast("string").alias("owner"), F.lit("").alias("name"), F.lit("").alias("descriptor"))
        targets = targets.union(providers.select(own.alias("_shape"), F.col("constructor").alias("dst")).distinct())
        calls = calls.union(providers.select(F.col("caller").alias("src"), own.alias("_shape")))
    leaves = methods.where("origin = 'JDK' OR no_op").select(F.col("node").alias("src"))
    targets = step(targets)
    calls = step(calls.distinct().join(leaves, "src", "left_anti"))
    levels, asked = _Levels(entrypoints.select("node").distinct()), None
    while not levels.last.isEmpty():
        new = levels.last.withColumnRenamed("node", "src").join(calls, "src").select("_shape").distinct()
        if asked is None:
            asked = _Levels(new)
        else:
            asked.add(new.join(asked.all(), "_shape", "left_anti"))
        levels.add(targets.join(asked.last, "_shape", "left_semi").select(F.col("dst").alias("node")).distinct().join(levels.all(), "node", "left_anti"))
    live = calls.join(levels.all().withColumnRenamed("node", "src"), "src", "left_semi")
    return pairs_by_runs(live, targets, ["_shape"]).select("src", "dst")


def closure(pairs: DataFrame) -> DataFrame:
    """Reflexive transitive closure of (sub, super)."""
    nodes = pairs.select(F.col("sub").alias("node")).union(pairs.select(F.col("super").alias("node"))).distinct()
    found = reach(pairs.select(F.col("sub").alias("src"), F.col("super").alias("dst")), nodes)
    return found.select(F.col("seed").alias("sub"), F.col("node").alias("super"))


def retained_ancestors(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(name) of the NO_OP dependency types above code whose bodies are analysed.

    types (name, origin, body), parents (sub, super).  The walk starts at the parents of PROJECT and REACTOR_DEPENDENCY
    types and of dependencies with REAL_IR bodies, and stops at JDK and synthetic types.
    """
    open_types = types.where("origin NOT IN ('JDK', 'SYNTHETIC')")
    start = open_types.where("origin IN ('PROJECT', 'REACTOR_DEPENDENCY') OR (origin = 'DEPENDENCY' AND body = 'REAL_IR')").select("name")
    up = parents.join(open_types.select(F.col("name").alias("super")), "super", "left_semi").select("sub", "super")
    frontier = step(up.join(start.withColumnRenamed("name", "sub"), "sub", "left_semi").select(F.col("super").alias("name")).distinct())
    seen = frontier
    while not frontier.isEmpty():
        above = up.join(frontier.withColumnRenamed("name", "sub"), "sub", "left_semi").select(F.col("super").alias("name")).distinct()
        frontier = step(above.join(seen, "name", "left_anti"))
        seen = step(seen.union(frontier))
    return open_types.where("origin = 'DEPENDENCY' AND body = 'NO_OP'").select("name").join(seen, "name", "left_semi")


def preorder(nodes: DataFrame) -> DataFrame:
    """(module, node, depth, place): the nodes of each tree in depth-first order, from (module, node, parent, ord).

    A node's place is the array of the sibling positions from the root down: arrays sort as the walk visits.
    """
    frontier = step(nodes.where("parent IS NULL").select("module", "node", F.lit(0).alias("depth"), F.array("ord").alias("place")))
    found = [frontier]
    children = nodes.where("parent IS NOT NULL").select("module", F.col("parent").alias("_above"), "node", "ord")
    while not frontier.isEmpty():
        above = frontier.select("module", F.col("node").alias("_above"), "depth", "place")
        frontier = step(children.join(above, ["module", "_above"]).select("module", "node", (F.col("depth") + 1).alias("depth"), F.array_append("place", F.col("ord")).alias("place")))
        found.append(frontier)
    return reduce(DataFrame.union, found)
