"""Pairs spelled out by runs: the pairs of pairs_by_place, in an order that files keep small."""

from itertools import pairwise

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rippleframe.operators import graph, places
from tests.conftest import SMALL


def test_runs_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(places, "RUN", 3)
    monkeypatch.setattr(places, "TASK_PAIRS", (5, 20))
    things = spark.createDataFrame([(i, p) for i in range(40) for p in {"abc"[i % 3], "abd"[i % 2]}] + [(1, "a"), (90, "z"), (91, None)], "thing int, place string")
    facts = spark.createDataFrame([(p, j, None if j == 4 else f"f{j}") for p in "abcd" for j in range(9) if (j + ord(p)) % 2] + [("a", 1, "f1"), (None, 2, "x")], "place string, fact int, name string")
    columns = ["thing", "fact", "name"]
    expected = sorted(map(str, places.pairs_by_place(things, facts, ["place"]).select(*columns).collect()))
    assert sorted(map(str, places.pairs_by_runs(things, facts, ["place"]).select(*columns).collect())) == expected and len(expected) > 100
    assert places.pairs_by_runs(things.limit(0), facts, ["place"]).count() == 0


def test_edges_of_a_target_stay_together(spark):
    """100 callers of 200 targets: a target is written once for a run of its callers, not once for each row."""
    sites = spark.range(100).select(F.col("id").alias("caller"), F.lit("A").alias("owner"), F.lit("m").alias("name"), F.lit("()").alias("descriptor"))
    methods = spark.range(300).select(F.col("id").alias("node"), F.lit("A").alias("owner"), F.lit("m").alias("name"), F.lit("()").alias("descriptor"), (F.col("id") >= 100).alias("concrete"), F.lit("PROJECT").alias("origin"), F.lit(False).alias("no_op"))
    rows = graph.call_graph(sites, methods, spark.createDataFrame([("A", "A")], "sub string, super string"), sites.select(F.col("caller").alias("node")))
    found = [r["dst"] for r in rows.collect()]
    assert len(found) == 20_000 and sum(a != b for a, b in pairwise(found)) < 1_000


def test_seeds_are_dealt_by_their_pairs(spark):
    """The tasks that spell out the seeds are as many as the pairs ask for, not as their packed tables do."""
    rows = entry.queries()["g15_seeds"](spark, SMALL)
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
