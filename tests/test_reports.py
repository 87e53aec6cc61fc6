"""Readers of POMs and writers of reports on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import keys as K
from rippleframe.operators import normalize, reactor, seeds, selection
from rippleframe.plans import affected, report
from rippleframe.sources import poms, render


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def write(folder, path, body):
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(f'<project xmlns="http://maven.apache.org/POM/4.0.0">{body}</project>')


def test_poms_and_scopes(spark, tmp_path):
    write(tmp_path, "pom.xml", "<groupId>g</groupId><artifactId>root</artifactId><version>${rev}</version><packaging>pom</packaging><properties><rev>7</rev><which>b</which></properties><modules><module>a</module></modules>"
          "<profiles><profile><id>jdk</id><activation><jdk>[11,18)</jdk></activation><modules><module>${which}</module></modules></profile><profile><id>dflt</id><activation><activeByDefault>true</activeByDefault></activation><modules><module>c</module></modules></profile></profiles>")
    for name in "abc":
        own = "<properties><rev>9</rev></properties>" if name == "b" else ""
        write(tmp_path, f"{name}/pom.xml", f"<parent><groupId>g</groupId><artifactId>root</artifactId><version>${{rev}}</version></parent><artifactId>{name}</artifactId>{own}")
    rows = {r["path"]: r for r in poms.read_poms(spark, str(tmp_path), {"java.version": "17.0.1"}).collect()}
    assert rows["pom.xml"]["coordinate"] == "g:root:7" and rows["pom.xml"]["packaging"] == "pom"
    assert rows["pom.xml"]["declared_modules"] == ["a", "b", "c"] and rows["pom.xml"]["active_modules"] == ["a", "b"]
    assert {p: r["coordinate"] for p, r in rows.items() if p != "pom.xml"} == {"a/pom.xml": "g:a:7", "b/pom.xml": "g:b:9", "c/pom.xml": "g:c:7"}
    again = poms.read_poms(spark, str(tmp_path), {"java.version": "8"}, active=("jdk",), inactive=("dflt",))
    assert again.where("path = 'pom.xml'").first()["active_modules"] == ["a", "b"]
    default = poms.read_poms(spark, str(tmp_path), {"java.version": "8"})
    assert default.where("path = 'pom.xml'").first()["active_modules"] == ["a", "c"]
    scopes = {r["requested"]: (r["mode"], r["root_pom"], r["active_poms"]) for r in reactor.reactor_scopes(default, default.select("path")).collect()}
    assert scopes["pom.xml"] == ("FULL_REACTOR", "pom.xml", ["a/pom.xml", "c/pom.xml", "pom.xml"])
    assert scopes["a/pom.xml"][:2] == ("SINGLE_MODULE", "pom.xml") and scopes["b/pom.xml"] == ("STANDALONE", "b/pom.xml", ["b/pom.xml"])
    assert reactor.scope_problems(reactor.reactor_scopes(default, default.select("path")), default).isEmpty()
    twice = default.withColumn("coordinate", F.lit("g:same:1"))
    assert {r["problem"] for r in reactor.scope_problems(reactor.reactor_scopes(twice, twice.select("path")), twice).collect()} == {"DUPLICATE_MODULE"}


def test_profile_conditions(spark, tmp_path):
    conditions = {
        "fam": "<os><family>unix</family></os>", "file": "<file><exists>${basedir}/src/../here.txt</exists></file>", "miss": "<file><missing>here.txt</missing></file>", "prop": "<property><name>own</name></property>",
        "win": "<os><family>windows</family></os>", "empty": "<os/>", "folder": "<file><exists>src</exists><missing>gone</missing></file>", "user": "<property><name>given</name><value>!no</value></property>",
        "absent": "<property><name>!own</name></property>", "both": "<jdk>17</jdk><os><arch>!amd64</arch></os>", "env": "<property><name>env.X</name><value>1</value></property>", "none": "", "blank": "<property/>",
    }
    profiles = "".join(f"<profile><id>{k}</id><activation>{v}</activation><modules><module>{k}</module></modules></profile>" for k, v in conditions.items())
    write(tmp_path, "pom.xml", f"<artifactId>r</artifactId><version>${{sys}}</version><properties><own>1</own><given>pom</given></properties><profiles>{profiles}<profile><id>d</id><activation><activeByDefault>TRUE</activeByDefault></activation><modules><module>d</module><module>d</module></modules></profile></profiles>")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("x")
    (tmp_path / "here.txt").write_text("x")
    system = {"java.version": "17.0.1", "os.name": "Linux", "os.arch": "amd64", "os.version": "6.1", "env.X": "1", "sys": "5"}
    row = poms.read_poms(spark, str(tmp_path), system, **poms.command_line(["-q", "-Dgiven=yes", "clean"])).first()
    assert row["active_modules"] == sorted(["fam", "file", "empty", "folder", "user", "absent", "env"]) and row["coordinate"] == "?:r:5"
    assert row["declared_modules"] == sorted([*conditions, "d", "d"])
    off = poms.read_poms(spark, str(tmp_path), {"os.name": "Windows 11", "own": "x", "given": "no"}, inactive=("empty", "file", "folder", "win"))
    assert off.first()["active_modules"] == ["prop"]
    none = poms.read_poms(spark, str(tmp_path), {"os.name": "Windows 11", "own": "x", "given": "no"}, inactive=("empty", "file", "folder", "win", "prop"))
    assert none.first()["active_modules"] == ["d", "d"]


def test_command_lines():
    got = poms.command_line(["-Pa,!b, -c,,", "-D", "k=v=w", "--activate-profiles", "d", "-P=e", "--define=x", "-Dy", "--activate-profiles=-f", "install"])
    assert got == {"active": ("a", "d", "e"), "inactive": ("b", "c", "f"), "user_properties": {"k": "v=w", "x": "true", "y": "true"}}


def test_poms_that_are_refused(spark, tmp_path):
    (tmp_path / "pom.xml").write_text('<!DOCTYPE project [<!ENTITY x "y">]><project/>')
    with pytest.raises(Exception, match="document type"):
        poms.read_poms(spark, str(tmp_path)).collect()
    other = tmp_path / "cycle"
    write(other, "a/pom.xml", "<parent><relativePath>../b/pom.xml</relativePath></parent><artifactId>a</artifactId>")
    write(other, "b/pom.xml", "<parent><relativePath>../a</relativePath></parent><artifactId>b</artifactId>")
    with pytest.raises(reactor.InvalidScope):
        poms.read_poms(spark, str(other)).collect()


def test_record_kinds(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<a&b>")], "id int, text string")
    path = f"{tmp_path}/report"
    render.write_tree_report(dict.fromkeys(render.TREE_KINDS, rows), path)
    assert [tuple(r) for r in render.read_records(spark, path, "class-conflicts", rows.schema).collect()] == [(1, "<a&b>")]
    for writer, kinds in ((render.write_tree_diff_report, render.TREE_DIFF_KINDS), (render.write_affected_path_report, render.AFFECTED_PATH_KINDS)):
        writer(dict.fromkeys(kinds, rows), f"{path}-{len(kinds)}")
        with pytest.raises(ValueError, match="missing"):
            writer(dict.fromkeys(kinds[1:], rows), path)
    with pytest.raises(ValueError, match="unknown"):
        render.write_tree_report({**dict.fromkeys(render.TREE_KINDS, rows), "more": rows}, path)
    render.write_diagnostics(rows, rows.union(rows), f"{path}-d")
    with pytest.raises(ValueError, match="one configuration"):
        render.write_diagnostics(rows.limit(0), rows, path)
    assert one(spark, render.script_safe(F.lit('{"a":"</s>&\u2028"}'))) == '{"a":"\\u003c/s\\u003e\\u0026\\u2028"}'


def test_spilled_fragments(spark, tmp_path):
    store, rows = render.SpillStore(spark, f"{tmp_path}/spill"), spark.range(5).toDF("id")
    name = store.spill("tree", rows)
    store.spill("diff", rows)
    assert store.read(name, "id long").count() == 5
    (tmp_path / "spill" / name / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="not complete"):
        store.read(name, "id long")
    assert store.discard("tree") == 1 and store.discard("tree") == 0 and store.discard("diff") == 1


def test_pages_survive_a_failure(spark, tmp_path):
    report_ = render.Publication(spark, f"{tmp_path}/pages")
    assert report_.state() == "RUNNING"
    report_.publish("a", spark.range(3).toDF("id"))
    report_.publish("b", spark.range(2).toDF("id"))
    with pytest.raises(Exception, match="broken"):
        report_.publish("c", spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("id")))
    report_.publish("a", spark.range(4).toDF("id"))
    report_.finish("COMPLETED_WITH_ISSUES")
    got = {r["reactor"]: r["count"] for r in report_.pages("id long, reactor string").groupBy("reactor").count().collect()}
    assert got == {"a": 4, "b": 2} and report_.state() == "COMPLETED_WITH_ISSUES"


def test_forced_and_oversized_shards(spark):
    rows = spark.createDataFrame([("k", i, s, i == 3) for i, s in enumerate([4, 4, 30, 4, 4])], "kind string, id long, bytes long, opens boolean")
    plan = report.shard_plan(rows, ["kind"], "id", "bytes", 10, 5, "opens")
    assert [r["shard_id"] for r in plan.orderBy("id").collect()] == [0, 0, 1, 2, 2]
    found = report.shard_descriptors(plan.join(rows, ["kind", "id"]), "kind", "id", "bytes").orderBy("shard_id").collect()
    assert [(r["file"], r["first_id"], r["last_id"], r["records"], r["bytes"]) for r in found] == [("k-00000.js", 0, 1, 2, 9), ("k-00001.js", 2, 2, 1, 30), ("k-00002.js", 3, 4, 2, 9)]


def test_text_tree_against_lookahead(spark):
    depth = [0, 1, 2, 3, 2, 1, 2, 3, 3, 1]
    nodes = spark.createDataFrame([("m", i, d, f"n{i}") for i, d in enumerate(depth)], "module string, ord int, depth int, label string")
    lines = [r["line"] for r in render.text_tree(nodes).orderBy("line_no").collect()]
    assert lines == ["n0", "+- n1", "|  +- n2", "|  |  \\- n3", "|  \\- n4", "+- n5", "|  \\- n6", "|     +- n7", "|     \\- n8", "\\- n9"]


def test_last_page(spark):
    query = report.ReportQuery(spark.range(25).toDF("id")).sorted("id").paged(10, 9)
    assert [r["id"] for r in query.clamped().result().collect()] == [20, 21, 22, 23, 24] and query.result().isEmpty()


def test_scalars(spark):
    assert one(spark, K.changed_signature(F.lit("a/B"), F.lit("f"), F.lit("()V"), F.lit("()I"))) == "a.B#f:()V → ()I"
    assert one(spark, K.changed_signature(F.lit("a/B"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "a.B#:"
    assert [one(spark, K.maven_supported(F.lit(v))) for v in ("3.6.2", "3.6.3", "3.9.9", "4.0.0", "4.0.0-rc-1")] == [False, True, True, False, False]
    assert one(spark, K.mebibytes(F.lit(1572864))) == "1.5 MiB"
    assert [one(spark, K.jar_excluded(F.lit(p))) for p in ("/x/lib/plugin.jar", "/x/plugin.jar/rt.jar")] == [True, False]


def test_seeds_and_limitations(spark):
    rows = [(1, "METHOD_REMOVED", 5, "e", None, None), (2, "METHOD_ACCESS_NARROWED", 5, "e", None, "INACCESSIBLE"), (3, "METHOD_ACCESS_NARROWED", 5, "e", False, "INACCESSIBLE"), (4, "METHOD_ACCESS_NARROWED", 5, "e", True, "ACCESSIBLE"),
            (5, "FIELD_ACCESS_NARROWED", 5, "e", None, "POTENTIALLY_INACCESSIBLE"), (6, "CLASS_REMOVED", None, "e", None, None), (7, "CLASS_ADDED", 5, "e", None, None)]
    got = {r["point_id"]: r["outcome"] for r in seeds.resolve_seeds(spark.createDataFrame(rows, "point_id int, kind string, node int, evidence_key string, declares boolean, check string")).collect()}
    assert got == {1: "SEED", 2: "LIMITATION", 4: "OBSERVATION", 5: "SEED"}


def test_scope_of_changed_paths(spark):
    nodes = spark.createDataFrame([(m, n, n == 0, n == 4) for m in (0, 1, 2) for n in range(5)], "module int, node long, is_root boolean, reactor boolean")
    edges = spark.createDataFrame([(m, a, b) for m in (0, 1, 2) for a, b in ((0, 1), (1, 2), (0, 3), (0, 4))] + [(2, 2, 1)], "module int, src long, dst long")
    got = {(r["module"], r["node"]): (r["body"], r["mode"], r["reason"]) for r in normalize.dependency_scopes(nodes, edges, spark.createDataFrame([(0, 2), (1, 9), (2, 2)], "module int, node long")).collect()}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 1): ("REAL_IR", "CHANGED_PATHS", None), (0, 2): ("REAL_IR", "CHANGED_PATHS", None), (0, 3): ("NO_OP", "CHANGED_PATHS", None)}
    assert {v for k, v in got.items() if k[0] == 1} == {("REAL_IR", "FULL", "SEED_MISSING")} and {v for k, v in got.items() if k[0] == 2} == {("REAL_IR", "FULL", "CYCLE")}


def test_pruned_occurrences(spark):
    raw = spark.createDataFrame([("m", 0, None, "compile", "g", "r"), ("m", 1, 0, "test", "g", "a"), ("m", 2, 1, "compile", "g", "b"), ("m", 3, 0, "compile", "g", "b"), ("m", 4, 0, "compile", "g", "z")], "module_key string, node long, parent long, scope string, group_id string, artifact_id string")
    winners = spark.createDataFrame([("m", "g", "r", "1"), ("m", "g", "b", "2")], "module_key string, group_id string, artifact_id string, version string")
    kept, lost = normalize.normalised_occurrences(raw, winners)
    assert {(r["node"], r["winning_version"]) for r in kept.collect()} == {(0, "1"), (3, "2")} and [r["node"] for r in lost.collect()] == [4]


def test_entrypoint_counts(spark):
    classes = spark.createDataFrame([("a/A",), ("a/B",)], "internal_name string")
    methods = spark.createDataFrame([("a/A", "<init>", False, "PUBLIC"), ("a/A", "f", True, "PUBLIC"), ("a/A", "g", False, "PRIVATE"), ("a/A", "h", False, "PACKAGE_PRIVATE")], "owner string, name string, is_abstract boolean, access string")
    assert {tuple(r) for r in selection.entrypoint_counts(classes, methods).collect()} == {("a/A", 2), ("a/B", 0)}


def test_member_filters(spark):
    rows = spark.createDataFrame([(1, "K", "g:a", "g:a:1", "S.f", 0, 0), (2, "K", "g:a", "g:a:1", "S.g", 2, 1), (3, "L", "g:b", "g:b:1", "T", 3, 0)], "member_id int, kind string, source string, dependency string, signature string, impact long, structural long")
    ids = lambda **k: [r["member_id"] for r in affected.changed_members(rows, **k).collect()]
    assert ids() == [3, 2, 1] and ids(chain="none") == [1] and ids(kind="K", chain="has") == [2] and ids(include=["g:?"], exclude=["*:b"]) == [2, 1] and ids(search=" s.F") == [1] and ids(member="T") == [3]
    with pytest.raises(ValueError, match="chain"):
        ids(chain="some")
    with pytest.raises(ValueError, match="view"):
        affected.view_type(rows, "x")


def test_shards_equal_a_fold(spark):
    rng = random.Random(8)
    rows = [(kind, i * 3, rng.choice([0, 1, 2, 5, 9, 10, 11, 40]), rng.random() < 0.06 or None) for kind in ("a", "b", None, "c") for i in range(rng.randint(1, 160))]
    frame = spark.createDataFrame(rows, "kind string, id long, bytes int, opens boolean").repartition(7)
    for most, n in ((10, 4), (25, 1000), (1000, 7), (0, 3)):
        want = {}
        for kind in {r[0] for r in rows}:
            shard = used = count = 0
            for _, i, size, opens in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1]):
                if count and (count >= n or opens or used + 1 + size > most):
                    shard, used, count = shard + 1, 0, 0
                used += size + (count > 0)
                count += 1
                want[kind, i] = shard
        got = {(r["kind"], r["id"]): r["shard_id"] for r in report.shard_plan(frame, ["kind"], "id", "bytes", most, n, "opens").collect()}
        assert got == want


def test_shards_of_many_chunks_equal_a_fold(spark, monkeypatch):
    """Shards shorter and longer than a chunk, kinds that begin at, after and within chunks, oversized and forced records."""
    rng = random.Random(35)
    rows = [(kind, i * 3, rng.choice([0, 1, 2, 5, 9, 10, 11, 40]), kind != "d" and rng.random() < 0.03 or None) for kind in ("a", "b", None, "c", "d") for i in range(rng.choice([1, 9, 160]))]
    rows += [("d", 1000 + i, 1, None) for i in range(150)]
    frame = spark.createDataFrame(rows, "kind string, id long, bytes int, opens boolean").repartition(7)
    for chunk, most, n in ((1, 25, 6), (12, 10, 4), (25, 60, 1000), (25, 1000, 7), (40, 0, 3), (12, 10_000, 1000)):
        monkeypatch.setattr(report, "TASK_RECORDS", chunk, raising=False)
        want = {}
        for kind in {r[0] for r in rows}:
            shard = used = count = 0
            for _, i, size, opens in sorted((r for r in rows if r[0] == kind), key=lambda r: r[1]):
                if count and (count >= n or opens or used + 1 + size > most):
                    shard, used, count = shard + 1, 0, 0
                used += size + (count > 0)
                count += 1
                want[kind, i] = shard, size
        got = {(r["kind"], r["id"]): (r["shard_id"], r["bytes"]) for r in report.shard_plan(frame, ["kind"], "id", "bytes", most, n, "opens", keep=("bytes",)).collect()}
        assert got == want


def test_shards_write_records_once(spark, monkeypatch):
    """what a plan writes and sorts again is a small part of the records, not all of them in every round."""
    written, plain = [], report.step

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(report, "step", counted)
    monkeypatch.setattr(report, "TASK_RECORDS", 2000, raising=False)
    rows = spark.range(20_000).select((F.col("id") % 3).alias("kind"), "id", F.lit(9).alias("bytes"))
    assert report.shard_plan(rows, ["kind"], "id", "bytes", 99, 100).agg(F.countDistinct("kind", "shard_id")).first()[0] == 3 * 667
    assert sum(written) < 1.2 * 20_000
