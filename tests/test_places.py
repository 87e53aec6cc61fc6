"""Pairs of things and facts at shared places: the same as sorting all pairs, but the pairs go through no exchange."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rippleframe.operators import impact, places, seeds
from tests.conftest import SMALL


def top(df):
    """The operators at the top of the plan, above the last joins."""
    plan, seen = df._jdf.queryExecution().optimizedPlan(), set()
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        seen.add(name)
        if name in ("Project", "Union", "Filter"):
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_pairs_by_place(spark):
    things = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (4, None)], "thing int, place string")
    facts = spark.createDataFrame([("a", 7), ("a", 7), ("a", 8), ("b", 7), ("c", 9), ("d", 1), (None, 2)], "place string, fact int")
    found = sorted(map(tuple, places.pairs_by_place(things, facts, ["place"]).select("thing", "fact").collect()))
    assert found == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 9)]


def test_pairs_are_not_sorted(spark):
    for name in ("j07_evidence", "j08_constant_evidence", "j09_dynamic_evidence", "j10_structural_evidence", "j15_unbound_seeds"):
        assert "Join" in top(entry.queries()[name](spark, SMALL)), name
    for name in ("g15_seeds", "j07_evidence", "j08_constant_evidence", "j09_dynamic_evidence", "j10_structural_evidence"):
        assert "Aggregate" not in top(entry.queries()[name](spark, SMALL)), name


def test_places_are_searched_before_their_points(spark):
    """300 points and 300 references at one place make 90,000 pairs, which no aggregate may see."""
    points = spark.range(300).select(F.col("id").alias("point_id"), F.lit("DEPENDENCY").alias("origin"), F.lit("x").alias("owner"), F.lit("METHOD_REMOVED").alias("kind"))
    paths = spark.range(300).select(F.lit("x").alias("owner"), F.lit("field").alias("reference"), F.lit("m").alias("affected_method"), F.array("id").alias("nodes"))
    found = seeds.structural_representatives(paths, paths, ("owner",), points)
    assert [tuple(r) for r in found.where("point_id = 5").collect()] == [(5, "field", "m", [0], "TRANSITIVE")] and found.count() == 300


def test_unbound_at_several_places(spark):
    points = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", "a"), (3, "l", "a")], "point_id long, kind string, place string")
    facts = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "place string, node int, evidence_key string")
    bound = spark.createDataFrame([("b", 1, "x"), ("b", 9, "y")], "place string, node int, evidence_key string")
    rows = seeds.unbound_at_places(points, facts, bound, ["place"], lambda pairs: pairs.where("kind = 'k'"))
    assert sorted(map(tuple, rows.collect())) == [(1, 2, "y"), (2, 1, "x")]


def test_structural_evidence(spark):
    references = spark.createDataFrame([("A", "m()", "X"), ("A", "f", "X"), ("B", "m()", "X"), ("B", "f", "Y")], "referencing_class string, member string, changed_class string")
    points = spark.createDataFrame([(1, "X", "CLASS_REMOVED"), (2, "X", "CLASS_ACCESS_NARROWED"), (3, "Y", "METHOD_REMOVED")], "point_id int, owner string, kind string")
    nodes = spark.createDataFrame([(10, "A", "m", "()"), (11, "A", "n", "()"), (12, "B", "m", "()"), (13, "B", "n", "()")], "node int, owner string, name string, descriptor string")
    rows = impact.structural_evidence(references, points, nodes)
    assert sorted(map(tuple, rows.collect())) == [(p, n) for p in (1, 2) for n in (10, 11, 12)]
