"""Large modules by joins give what small ones give in a task; numbers and ranges over any partitions."""

from pyspark.sql import functions as F

from rippleframe.operators import graph, normalize
from rippleframe.plans import report


def test_problems_of_large_modules(spark, monkeypatch):
    """One module for each problem; none goes through a task's Python where modules count as large."""
    edges = [(0, 1, 2), (0, 2, 3), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 9), (4, 1, 2), (4, 2, 3), (4, 3, 2), (5, 1, 2), (6, 1, 2), (6, 1, 3), (6, 2, 3), (7, 1, 2)]
    nodes = [(m, n, n == 1 and m != 1 or m == 2) for m in range(7) for n in (1, 2, 3)]
    tables = spark.createDataFrame(nodes, "module int, node long, is_root boolean"), spark.createDataFrame(edges, "module int, src long, dst long")
    expected = {0: None, 1: "ROOT_MISSING", 2: "MULTIPLE_ROOTS", 3: "EDGE_INCOMPLETE", 4: "CYCLE", 5: "UNREACHABLE", 6: None, 7: "ROOT_MISSING"}
    monkeypatch.setattr(graph, "SMALL_MODULE", 1)
    monkeypatch.setattr(graph, "_strong", None)
    monkeypatch.setattr(graph, "_small_components", lambda rows: rows.selectExpr("module", "src AS node", "src AS component", "1L AS size", "false AS cyclic").limit(0))
    assert {r["module"]: r["problem"] for r in graph.validate_occurrence_graph(*tables).collect()} == expected


def test_ranges_of_repeated_and_null_ids(spark, monkeypatch):
    """Tasks grow in number with the rows: no task has many more ids than it is meant to."""
    monkeypatch.setattr(report, "TASK_IDS", 10)
    ids = [("a", i) for i in [*range(50), *range(20), 60, 61]] + [("b", 5), ("b", None), ("b", None)] + [(f"c{i}", i) for i in range(200)]
    found = report.id_ranges(spark.createDataFrame(ids, "g string, id long"), ["g"], "id")
    assert found.rdd.getNumPartitions() >= len(ids) // 10
    assert {tuple(r) for r in found.where("g < 'c'").collect()} == {("a", 0, 50), ("a", 60, 2), ("b", 5, 1), ("b", None, 1)}


def test_nodes_that_many_look_at(spark, monkeypatch):
    """The nearest places are the same whether a node goes through the exchange or to every task."""
    rows = [(0, n, (n // 3 or 1) if n > 1 else None, n, "test" if n % 17 == 5 else "compile", n % 5 == 3) for n in range(1, 200)]
    nodes = spark.createDataFrame(rows, "module int, node long, parent long, ord long, scope string, reactor boolean")
    plain = {tuple(r) for r in normalize.selected_tree(nodes).collect()}
    monkeypatch.setattr(normalize, "HOT", 2)
    assert {tuple(r) for r in normalize.selected_tree(nodes).collect()} == plain and len(plain) > 50


def test_rounds_of_components_send_nothing_to_the_driver(spark, monkeypatch):
    """No step of the rounds broadcasts a table."""
    plans = []
    plain = graph.step
    monkeypatch.setattr(graph, "step", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3)], "module int, src long, dst long")
    found = graph._large_components(edges, edges.select("module", F.col("src").alias("node")))
    assert {(r["node"], r["component"], r["cyclic"]) for r in found.collect()} == {(1, 1, True), (2, 1, True), (3, 3, False)}
    assert plans and not any("BroadcastExchange" in p for p in plans)
