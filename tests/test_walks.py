"""Walks that send nothing through the driver, many small modules in one task, and call graphs by shapes of sites."""

import random

from pyspark.sql import functions as F

from rippleframe.operators import graph


def test_levels_are_not_broadcast(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    plan = graph.reach(edges, spark.createDataFrame([(0,)], "node long"))
    levels = graph._Levels(spark.range(3).withColumnRenamed("id", "node"))
    joined = levels.last.join(edges, F.col("node") == F.col("src")).join(levels.all().withColumnRenamed("node", "dst"), "dst", "left_anti")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 6


def test_many_small_modules(spark):
    """Modules that share tasks and cross batches, null among them, stay apart; they take no call for each."""
    rng = random.Random(5)
    edges = [(m, rng.randrange(4), rng.randrange(4)) for m in [*range(3000), None] for _ in range(4)]
    found = graph.strong_components(spark.createDataFrame(edges, "module int, src long, dst long"))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["module"], r["node"]): (r["component"], r["size"], r["cyclic"]) for r in found.collect()}
    by: dict = {}
    for m, a, b in edges:
        by.setdefault(m, set()).add((a, b))
    expected = {}
    for m, pairs in by.items():
        reach = set(pairs)
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        for n in {x for p in pairs for x in p}:
            same = {n} | {x for x in range(4) if (n, x) in reach and (x, n) in reach}
            expected[m, n] = (min(same), len(same), (n, n) in reach)
    assert got == expected


def test_call_graph_by_shapes(spark):
    """Two sites of one caller that share a target give one edge, and a provider's constructor may be one of them."""
    sites = spark.createDataFrame([(1, "A", "m", "()"), (1, "B", "m", "()"), (3, "A", "m", "()"), (9, "A", "m", "()")], "caller long, owner string, name string, descriptor string")
    methods = spark.createDataFrame([(2, "B", "m", "()", True, "PROJECT", False), (3, "A", "m", "()", True, "PROJECT", False), (4, "C", "k", "()", True, "PROJECT", False)], "node long, owner string, name string, descriptor string, concrete boolean, origin string, no_op boolean")
    subtypes = spark.createDataFrame([("A", "A"), ("B", "B"), ("B", "A"), ("C", "C")], "sub string, super string")
    providers = spark.createDataFrame([(2, 4), (2, 4), (1, 2)], "caller long, constructor long")
    rows = graph.call_graph(sites, methods, subtypes, spark.createDataFrame([(1,)], "node long"), providers)
    assert "Aggregate" != rows._jdf.queryExecution().optimizedPlan().nodeName()
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (1, 3), (2, 4), (3, 2), (3, 3)]
