"""Nothing is cut at a fixed depth."""

from rippleframe.operators import graph
from rippleframe.sources import facts


def test_deep_dependency_text(spark):
    lines = [("f", i, "[INFO] " + ("   " * (i - 1) + "+- " if i else "") + f"g:a{i}:jar:1:compile") for i in range(40)]
    rows = facts.parse_dependency_text(spark.createDataFrame(lines, "file string, line_no int, line string")).orderBy("line_no").collect()
    assert len(rows) == 40 and [len(r["path"]) for r in rows] == list(range(1, 41))


def test_reach_and_paths_of_any_length(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(25)], "module int, src long, dst long")
    assert graph.reach(edges, spark.createDataFrame([(0,)], "node long")).count() == 26
    paths = graph.simple_paths(edges, spark.createDataFrame([(25,)], "node long")).collect()
    assert [r["path"] for r in paths] == [list(range(26))]
