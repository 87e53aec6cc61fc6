"""Fixtures for semantics that the stand-in tables do not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import keys as K
from rippleframe.functions.textdiff import unified
from rippleframe.operators import diff, graph, impact, versions
from rippleframe.plans import report
from rippleframe.sources import facts, render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_coordinate_forms(spark):
    assert one(spark, K.coordinate_parts(F.lit("g:a:jar:c:1:compile")))["classifier"] == "c"
    assert one(spark, K.coordinate_parts(F.lit("g:a:jar:1:c")))["classifier"] == ""
    assert one(spark, K.tree_coordinate_parts(F.lit("g:a:jar:1:compile")))["scope"] == "compile"
    five = one(spark, K.tree_coordinate_parts(F.lit("g:a:jar:c:1")))
    assert (five["classifier"], five["version"]) == ("c", "1")
    assert one(spark, K.coordinate_parts(F.lit("g:a"))) is None


def test_selectors():
    assert K.parse_scopes("Compile, test,compile") == ["compile", "test"]
    with pytest.raises(ValueError):
        K.parse_scopes("other")
    with pytest.raises(ValueError):
        K.artifact_regex("a b:c")
    for bad in ("/a", "a//b", "a.b", "**/a", "a$/b"):
        with pytest.raises(ValueError):
            K.entrypoint_regex(bad)


def test_ranges_and_properties(spark):
    cases = [("[1.8,)", "17", True), ("(1.8,9]", "1.8", False), ("1.8", "1.80", True), ("!1.8", "1.80", False), ("[1.8,9)", "9", False)]
    for condition, jdk, expected in cases:
        assert one(spark, K.jdk_in_range(F.lit(condition), F.lit(jdk))) is expected, condition
    none = F.lit(None).cast("string")
    assert one(spark, K.property_active(F.lit("!p"), none, none)) is True
    assert one(spark, K.property_active(F.lit("p"), F.lit("!v"), none)) is True
    assert one(spark, K.property_active(F.lit("p"), F.lit(""), F.lit("x"))) is True


def test_unchanged_rows_and_nulls(spark):
    b = spark.createDataFrame([("k", None, "compile"), ("gone", "1", "compile")], "key string, version string, scope string")
    t = spark.createDataFrame([("k", None, "runtime"), ("new", "1", "test")], "key string, version string, scope string")
    rows = {r["key"]: (r["base_type"], r["scope_changed"]) for r in diff.tree_diff(b, t, ["key"]).collect()}
    assert rows == {"k": ("RESOLVED_UNCHANGED", True), "gone": ("REMOVED", False), "new": ("ADDED", False)}
    assert {r["key"] for r in diff.dependency_changes(b, t, ["key"]).collect()} == {"gone", "new"}


def test_descriptor_change_needs_its_kind(spark):
    schema = "owner string, name string, descriptor string, access string, body_hash string"
    b, t = spark.createDataFrame([("C", "m", "()V", "PUBLIC", "1")], schema), spark.createDataFrame([("C", "m", "(I)V", "PUBLIC", "1")], schema)
    assert [r["kind"] for r in diff.method_diff(b, t).collect()] == ["METHOD_DESCRIPTOR_CHANGED"]
    assert {r["kind"] for r in diff.method_diff(b, t, ["METHOD_ADDED", "METHOD_REMOVED"]).collect()} == {"METHOD_ADDED", "METHOD_REMOVED"}


def test_graph_kernels(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 4, 3), (0, 5, 5)], "module int, src long, dst long")
    comps = {r["node"]: (r["component"], r["cyclic"]) for r in graph.strong_components(edges).collect()}
    assert comps == {1: (1, True), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, True)}
    paths = {r["node"]: (r["level"], r["next"]) for r in graph.reverse_paths(edges, spark.createDataFrame([(0, 3)], "module int, node long")).collect()}
    assert paths == {3: (0, None), 2: (1, 3), 4: (1, 3), 1: (2, 2)}
    found = {tuple(r["path"]) for r in graph.simple_paths(edges.where("src <> dst and not (src = 2 and dst = 1)"), spark.createDataFrame([(3,)], "node long")).collect()}
    assert found == {(1, 2, 3), (4, 3)}
    nodes = spark.createDataFrame([(0, n, f"m{n}", "PROJECT" if n in (1, 4) else "DEPENDENCY", n == 4) for n in range(1, 6)], "module int, node long, method string, origin string, is_entrypoint boolean")
    roots = {(r["root"], r["cycle"]) for r in graph.impact_roots(edges, graph.strong_components(edges), nodes).collect()}
    assert roots == {(1, True), (4, False)}
    # another context of the root's method is called: a root that is no cycle goes
    again = edges.union(spark.createDataFrame([(0, 1, 6)], edges.schema))
    called = nodes.union(spark.createDataFrame([(0, 6, "m4", "PROJECT", False)], nodes.schema))
    assert {(r["root"], r["cycle"]) for r in graph.impact_roots(again, graph.strong_components(again), called).collect()} == {(1, True)}


def test_components_by_brute_force(spark, monkeypatch):
    r = random.Random(1)
    for limit in (200_000, 26, 0):  # all modules small, one of them large, both large
        monkeypatch.setattr(graph, "SMALL_MODULE", limit)
        edges = sorted({(m, r.randrange(14), r.randrange(14)) for m in (0, 1) for _ in range(11 + 8 * m)})
        reach = {(m, a): {a} for m in (0, 1) for a in range(14)}
        for _ in range(14):
            for m, a, b in edges:
                for k in reach:
                    if k[0] == m and a in reach[k]:
                        reach[k].add(b)
        nodes = spark.createDataFrame([(m, a) for m in (0, 1) for a in range(14)], "module int, node long")
        got = {(x["module"], x["node"]): (x["component"], x["size"], x["cyclic"]) for x in graph.strong_components(spark.createDataFrame(edges, "module int, src long, dst long"), nodes).collect()}
        for (m, a), there in reach.items():
            members = [b for b in there if a in reach[m, b]]
            assert got[m, a] == (min(members), len(members), len(members) > 1 or (m, a, a) in edges)


def test_first_discoverers_by_a_queue(spark):
    r = random.Random(3)
    method = {n: f"m{r.randrange(5)}" for n in range(30)}
    edges = sorted({(r.randrange(30), r.randrange(30)) for _ in range(70)})
    gone, synthetic = set(edges[::9]), {7}
    callers = {}
    for a, b in edges:
        if (a, b) not in gone and a not in synthetic:
            callers.setdefault(b, []).append(a)
    level, following, queue = {0: 0}, {0: None}, [0]
    for node in queue:
        for c in sorted(callers.get(node, ()), key=lambda n: (method[n], n)):
            if c not in level:
                level[c], following[c] = level[node] + 1, node
                queue.append(c)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.reverse_paths(
        frame([(0, a, b) for a, b in edges], "module int, src long, dst long"), frame([(0, 0)], "module int, node long"),
        frame([(0, n, method[n], n in synthetic) for n in range(30)], "module int, node long, method string, synthetic boolean"), frame([(0, a, b) for a, b in gone], "module int, caller_id long, callee_id long"),
    ).collect()
    assert {x["node"]: (x["level"], x["next"]) for x in got} == {n: (level[n], following[n]) for n in level}
    paths = graph.follow(frame([tuple(x) for x in got], "module int, seed long, node long, level int, next long"), frame([(0, 0, n) for n in level], "module int, seed long, node long"), ["module", "seed"]).collect()
    assert {x["node"] for x in paths} == set(level)
    for x in paths:
        path = [x["node"]]
        while following[path[-1]] is not None:
            path.append(following[path[-1]])
        assert x["path"] == path


def test_unknown_verdicts_keep_edges(spark):
    rows = [(0, 1, 2, True, 3, "EXCLUDES"), (0, 1, 2, True, 3, None), (0, 1, 3, True, 3, "EXCLUDES"), (0, 1, 4, None, 3, "EXCLUDES"), (0, 1, 5, True, None, "EXCLUDES"), (0, 1, 6, True, 1, "EXCLUDES")]
    sites = spark.createDataFrame(rows, "module int, caller_id long, callee_id long, is_dispatch boolean, n_targets int, receiver_verdict string")
    assert [r["callee_id"] for r in impact.pruned_edges(sites).collect()] == [3]


def test_last_occurrence_of_a_path_stands(spark):
    rows = [(1, "1", "1", "compile", 1, "a"), (2, "1", "2", "test", 1, "a"), (3, "3", "3", "runtime", 2, "b")]
    occ = spark.createDataFrame([("m", "g", "x", *r) for r in rows], "module_key string, group_id string, artifact_id string, seq long, selected_version string, effective_version string, effective_scope string, depth int, path string")
    r = versions.aggregate_dependencies(occ, ["module_key"]).first()
    assert (r["selected_version"], r["effective_scope"], r["direct"], r["n_paths"], [tuple(p) for p in r["paths"]]) == ("1", "compile", True, 2, [("a", "2", "test"), ("b", "3", "runtime")])


@pytest.mark.parametrize(
    ("roots", "edges", "problem"),
    [([], [(1, 2)], "ROOT_MISSING"), ([1, 2], [(1, 2)], "MULTIPLE_ROOTS"), ([1], [(1, 9)], "EDGE_INCOMPLETE"), ([1], [(1, 2), (2, 1)], "CYCLE"), ([1], [(1, 1)], "CYCLE"), ([1], [], "UNREACHABLE"), ([1], [(1, 2)], None)],
)
def test_graph_validation(spark, roots, edges, problem):
    nodes = spark.createDataFrame([(0, n, n in roots) for n in (1, 2)], "module int, node long, is_root boolean")
    frame = spark.createDataFrame([(0, *e) for e in edges], "module int, src long, dst long")
    assert graph.validate_occurrence_graph(nodes, frame).first()["problem"] == problem


def test_dispatch_and_closure(spark):
    subtypes = graph.closure(spark.createDataFrame([("B", "A"), ("C", "B")], "sub string, super string"))
    assert subtypes.count() == 6
    sites = spark.createDataFrame([(10, "A", "m", "()")], "caller long, owner string, name string, descriptor string")
    methods = spark.createDataFrame([(1, "A", "m", "()", False), (2, "B", "m", "()", True), (3, "C", "m", "()", True), (4, "X", "m", "()", True)], "node long, owner string, name string, descriptor string, concrete boolean")
    assert {(r["src"], r["dst"]) for r in graph.dispatch_edges(sites, methods, subtypes).collect()} == {(10, 2), (10, 3)}


def test_report_query_errors(spark):
    q = report.ReportQuery(spark.range(3), known={"id": {0, 1}})
    with pytest.raises(ValueError):
        q.exact("id", 7)
    assert q.exact("id", 1).result().count() == 1


def test_greedy_shards(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 4, 20, 1, 1, 1])], "kind string, id long, bytes long")
    plan = {r["id"]: r["shard_id"] for r in report.shard_plan(rows, ["kind"], "id", "bytes", 10, 2).collect()}
    assert plan == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_text_difference():
    assert unified("a\nb", "a\nb") == ""
    assert unified("a\r\nb\rc", "a\nb\nc") == "" and unified("a\x0cb", "a\nb") != ""
    assert unified("a\n", "a") == "@@ -1,2 +1,1 @@\n a\n-" and unified("", "x") == "@@ -1,1 +1,1 @@\n-\n+x"
    assert unified("a\nb\nc", "a\nx\nc") == "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"
    far = "\n".join(map(str, range(20)))
    assert unified(far, far.replace("0\n1\n", "z\n1\n", 1).replace("18", "y")).count("@@ -") == 2


def test_dependency_text(spark):
    lines = ["[INFO] g:root:jar:1", "[INFO] +- g:a:jar:1:compile", "[INFO] |  \\- g:b:jar:2:runtime (version managed from 1; omitted for conflict with 3)", "[INFO] \\- g:c:jar:t:1:test"]
    frame = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    rows = facts.parse_dependency_text(frame).orderBy("line_no").collect()
    assert [(r["depth"], r["artifact_id"], r["scope"]) for r in rows] == [(0, "root", ""), (1, "a", "compile"), (2, "b", "runtime")]
    assert (rows[2]["managed_from_version"], rows[2]["omitted_reason"], rows[2]["conflict_version"]) == ("1", "conflict", "3")
    assert rows[2]["path"] == ["g:root:jar:1", "g:a:jar:1:compile", "g:b:jar:2:runtime"]
    tree = render.text_tree(rows and spark.createDataFrame([("m", i, d, x) for i, (d, x) in enumerate([(0, "r"), (1, "a"), (2, "b"), (1, "c")])], "module string, ord int, depth int, label string"))
    assert [r["line"] for r in tree.orderBy("line_no").collect()] == ["r", "+- a", "|  \\- b", "\\- c"]


def test_strict_evidence(spark, tmp_path):
    module = dict.fromkeys(["groupId", "artifactId", "type", "extension", "classifier", "version", "baseVersion"], "x")
    good = {"schemaVersion": 1, "javaMajor": 17, "module": module, "moduleDirectory": "/m", "issues": [], "entries": [{"order": 0, "origin": "PROJECT", "coordinates": module, "scope": "", "absolutePath": "/p"}]}
    for name, change, ok in [("good", {}, True), ("extra", {"more": 1}, False), ("version", {"schemaVersion": 2}, False), ("order", {"entries": [good["entries"][0] | {"order": 1}]}, False), ("scope", {"entries": [good["entries"][0] | {"scope": "compile"}]}, False)]:
        (tmp_path / f"{name}.json").write_text(json.dumps(good | change))
        if ok:
            assert facts.read_classpath_evidence(spark, str(tmp_path / f"{name}.json")).count() == 1
        else:
            with pytest.raises(facts.InvalidDocument):
                facts.read_classpath_evidence(spark, str(tmp_path / f"{name}.json"))


def test_profiles(spark):
    rows = [("p", "a", None, [True], False), ("p", "b", None, [], True), ("q", "c", None, [], True), ("q", "d", "INACTIVE", [True], False)]
    active = {(r["pom"], r["id"]): r["active"] for r in facts.active_profiles(spark.createDataFrame(rows, "pom string, id string, forced string, conditions array<boolean>, active_by_default boolean")).collect()}
    assert active == {("p", "a"): True, ("p", "b"): False, ("q", "c"): True, ("q", "d"): False}


def test_all_skipped_is_success(spark):
    rows = spark.createDataFrame([("r", "SKIPPED")], "reactor string, status string")
    assert impact.overall_status(rows, ["reactor"]).first()["status"] == "SUCCESS"


def test_selected_tree_splices_reactor_nodes(spark):
    from rippleframe.operators import normalize

    rows = [(0, 1, None, 0, "", True), (0, 2, 1, 1, "compile", True), (0, 3, 2, 2, "runtime", False), (0, 4, 1, 3, "test", False), (0, 5, 4, 4, "compile", False)]
    frame = spark.createDataFrame(rows, "module int, node long, parent long, ord int, scope string, reactor boolean")
    assert {(r["node"], r["parent"]) for r in normalize.selected_tree(frame).collect()} == {(1, None), (3, 1)}
    paths = spark.createDataFrame([([1, 3],)], "path array<long>")
    nodes = spark.createDataFrame([(1, True, True), (3, False, False), (9, False, False)], "node long, reactor boolean, is_root boolean")
    assert {(r["node"], r["body"]) for r in normalize.changed_path_bodies(paths, nodes).collect()} == {(3, "REAL_IR"), (9, "NO_OP")}


def test_empty_selection_raises(spark):
    from rippleframe.operators import selection

    classes = spark.createDataFrame([("a/B", False, "PUBLIC"), ("a/C", True, "PUBLIC"), ("module-info", False, "PUBLIC")], "internal_name string, is_interface boolean, access string")
    assert [r["internal_name"] for r in selection.entrypoint_classes(classes, ["a/*"]).collect()] == ["a/B"]
    with pytest.raises(selection.EmptySelection):
        selection.entrypoint_classes(classes, ["z/*"])


def test_constant_and_structural_evidence(spark):
    points = spark.createDataFrame([(1, "CLASS_REMOVED", "a/B", None), (2, "SERVICE_PROVIDER_REGISTRATION_REMOVED", "svc", None)], "point_id int, kind string, owner string, name string")
    literals = spark.createDataFrame([(10, "PROJECT", "forName", "a.B"), (11, "JDK", "forName", "a.B"), (12, "PROJECT", "load", "svc")], "node int, origin string, call string, literal string")
    services = spark.createDataFrame([("svc", "p")], "service string, provider string")
    assert {(r["point_id"], r["node"]) for r in impact.constant_evidence(literals, points, services).collect()} == {(1, 10), (2, 12)}
    references = spark.createDataFrame([("X", "m()", "a/B"), ("X", "field", "a/B")], "referencing_class string, member string, changed_class string")
    nodes = spark.createDataFrame([(5, "X", "m", "()"), (6, "X", "n", "()")], "node int, owner string, name string, descriptor string")
    assert {(r["point_id"], r["node"]) for r in impact.structural_evidence(references, points, nodes).collect()} == {(1, 5), (1, 6)}


def test_streaming_peaks(spark, tmp_path):
    from rippleframe.streaming.metrics import windowed_peaks

    spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 2.0)], "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = windowed_peaks(stream).writeStream.format("memory").queryName("peaks").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["n"], r["peak"]) for r in spark.table("peaks").collect()] == [(2, 3.0)]
