"""Registered queries over stand-in facts of classes, members, profiles and paths, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import diff, graph, impact, normalize, ownership, selection
from ..operators.steps import step
from ..sources import facts
from . import report
from .bindings import bound
from .catalog import _FIRST, MODULE_KEY, ORACLE_SQL, _first, _sides, query


def _part(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


# --- coordinates, selectors, predicates ------------------------------------------------------------------------------
@query("f02_tree_coordinates", """SELECT p_partkey, p_brand AS group_id, CASE WHEN p_size % 4 IN (1, 3) THEN 'c' ELSE '' END AS classifier, concat('v', p_size) AS version, CASE p_size % 4 WHEN 2 THEN 'import' WHEN 3 THEN 'test' ELSE '' END AS scope FROM part""")
def f02_tree_coordinates(spark, sf):
    v = F.concat(F.lit("v"), "p_size")
    kind = F.col("p_size") % 4
    label = F.when(kind == 0, F.concat_ws(":", "p_brand", F.lit("a:jar"), v)).when(kind == 1, F.concat_ws(":", "p_brand", F.lit("a:jar:c"), v)).when(kind == 2, F.concat_ws(":", "p_brand", F.lit("a:jar"), v, F.lit("import"))).otherwise(F.concat_ws(":", "p_brand", F.lit("a:jar:c"), v, F.lit("test")))
    c = K.tree_coordinate_parts(label)
    return _part(spark, sf).select("p_partkey", *(c[f].alias(f) for f in ("group_id", "classifier", "version", "scope")))


@query("f03_scopes", """ SELECT effective_scope, count(*) AS n FROM occ WHERE effective_scope IN ('runtime', 'provided') GROUP BY ALL""", ("occ",))
def f03_scopes(spark, sf):
    return bound(spark, sf, "occ").where(F.col("effective_scope").isin(*K.parse_scopes(" Runtime, provided,RUNTIME"))).groupBy("effective_scope").agg(F.count(F.lit(1)).alias("n"))


@query("f04_globs", """SELECT p_partkey FROM part WHERE regexp_full_match(concat(p_brand, ':', p_name), 'Brand#.:.*a.*')""")
def f04_globs(spark, sf):
    return _part(spark, sf).where(F.concat_ws(":", "p_brand", "p_name").rlike(K.artifact_regex("Brand#?:*a*"))).select("p_partkey")


@query("f09_default_kinds", """ SELECT point_id, kind FROM points WHERE kind NOT IN ('CLASS_ADDED', 'METHOD_ADDED', 'FIELD_ADDED')""", ("points",))
def f09_default_kinds(spark, sf):
    return selection.of_kinds(bound(spark, sf, "points")).select("point_id", "kind")


@query("f12_graph_relevant", """ SELECT kind, count(*) AS n FROM points WHERE kind <> 'METHOD_ADDED' GROUP BY kind""", ("points",))
def f12_graph_relevant(spark, sf):
    return impact.graph_relevant(bound(spark, sf, "points")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f13_jdk_exclusions", """SELECT p_partkey, p_size % 3 = 0 AS class_excluded, p_size % 5 = 2 AS jar_excluded FROM part""")
def f13_jdk_exclusions(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Ljavax/swing/T"), "p_partkey")).otherwise(F.concat(F.lit("org/javax/swing/T"), "p_partkey"))
    jar = F.when(F.col("p_size") % 5 == 2, F.lit("/jdk/lib/deploy.jar")).otherwise(F.lit("/jdk/deploy.jar/rt.jar"))
    return _part(spark, sf).select("p_partkey", K.jdk_excluded(name).alias("class_excluded"), K.jar_excluded(jar).alias("jar_excluded"))


@query("f16_properties", """SELECT p_partkey, p_size % 5 AS k, CASE p_size % 5 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 1 WHEN 2 THEN p_size % 2 = 1 AND p_size % 3 = 1 WHEN 3 THEN p_size % 2 = 0 OR p_size % 3 <> 1 ELSE p_size % 2 = 1 END AS active FROM part""")
def f16_properties(spark, sf):
    size = F.col("p_size")
    actual = F.when(size % 2 == 1, (size % 3).cast("string"))
    condition = F.when(size % 5 == 0, "!name").otherwise("name")
    wanted = F.when(size % 5 == 1, " ").when(size % 5 == 2, "1").when(size % 5 == 3, "!1")
    return _part(spark, sf).select("p_partkey", (size % 5).alias("k"), K.property_active(condition, wanted, actual).alias("active"))


_SYSTEMS = ["Linux", "Windows 98", "Mac OS X", "OpenVMS", "FreeBSD", "Windows 11", "OS/2", "MS-DOS"]
_FAMILIES = ["unix", "Windows", "!unix", "win9x", "mac", "dos", " ", "bsd", "!win9x", None]


@query("f18_systems", """, n AS (SELECT p_partkey, lower(['Linux', 'Windows 98', 'Mac OS X', 'OpenVMS', 'FreeBSD', 'Windows 11', 'OS/2', 'MS-DOS'][1 + p_partkey % 8]) AS s, p_size % 10 AS f, concat('10.', p_size % 4) AS v, cast(trunc(p_retailprice) AS BIGINT) % 5 AS k FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN s NOT LIKE '%windows%' AND s NOT IN ('openvms', 'os/2') WHEN 1 THEN s LIKE '%windows%' WHEN 2 THEN s LIKE '%windows%' OR s IN ('openvms', 'os/2') WHEN 3 THEN s = 'windows 98' WHEN 4 THEN s = 'mac os x' WHEN 5 THEN s = 'ms-dos' WHEN 7 THEN s = 'freebsd' WHEN 8 THEN s <> 'windows 98' ELSE true END AS of_family,
  CASE k WHEN 0 THEN s = 'linux' WHEN 1 THEN s <> 'linux' ELSE true END AS of_name, CASE k WHEN 0 THEN v = '10.1' WHEN 1 THEN v <> '10.1' WHEN 2 THEN v IN ('10.1', '10.2') WHEN 3 THEN v = '10.3' ELSE true END AS of_version FROM n""".replace(", n AS", "WITH n AS", 1))
def f18_systems(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), at.cast("int") + 1)
    kind = F.col("p_retailprice").cast("bigint") % 5
    name, version = pick(_SYSTEMS, F.col("p_partkey") % 8), F.concat(F.lit("10."), (F.col("p_size") % 4).cast("string"))
    return _part(spark, sf).select(
        "p_partkey", K.os_family(pick(_FAMILIES, F.col("p_size") % 10), name).alias("of_family"), K.os_value(pick(["LINUX", "!Linux", "", " ", None], kind), name).alias("of_name"),
        K.os_version(pick(["10.1", "!10.1", "regex:10\\.[12]", "REGEX:.*3", None], kind), version).alias("of_version"),
    )


@query("f15_profiles", """WITH p AS (SELECT p_size AS pom, p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'INACTIVE' WHEN 1 THEN 'ACTIVE' END AS forced, p_partkey % 7 < 2 AS by_default, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_partkey % 13 = 0 ELSE p_partkey % 17 = 0 END AS own FROM part),
q AS (SELECT *, coalesce(CASE WHEN forced = 'INACTIVE' THEN false WHEN forced = 'ACTIVE' THEN true ELSE own END, false) AS o FROM p)
SELECT pom, id, o OR (by_default AND NOT bool_or(o) OVER (PARTITION BY pom) AND coalesce(forced <> 'INACTIVE', true)) AS active FROM q""")
def f15_profiles(spark, sf):
    key = F.col("p_partkey")
    conditions = F.when(key % 3 == 0, F.array().cast("array<boolean>")).when(key % 3 == 1, F.array(F.lit(True), key % 13 == 0)).otherwise(F.array(key % 17 == 0))
    rows = _part(spark, sf).select(F.col("p_size").alias("pom"), key.alias("id"), F.when(key % 11 == 0, "INACTIVE").when(key % 11 == 1, "ACTIVE").alias("forced"), conditions.alias("conditions"), (key % 7 < 2).alias("active_by_default"))
    return facts.active_profiles(rows).select("pom", "id", "active")


@query("f08_entry_methods", """ SELECT owner, name, descriptor FROM method_info WHERE side = 'target' AND body_hash IS NOT NULL AND access <> 'PRIVATE'""", ("method_info",))
def f08_entry_methods(spark, sf):
    rows = bound(spark, sf, "method_info").where("side = 'target'").withColumn("is_abstract", F.col("body_hash").isNull())
    return selection.entrypoint_methods(rows).select("owner", "name", "descriptor")


@query("f07_entry_counts", """, c AS (SELECT owner FROM class_info WHERE side = 'target' AND access <> 'PRIVATE' AND NOT regexp_full_match(owner, 'o.*9'))
SELECT c.owner AS internal_name, count(m.owner) AS n_methods FROM c LEFT JOIN method_info m ON m.owner = c.owner AND m.side = 'target' AND m.body_hash IS NOT NULL AND m.access <> 'PRIVATE' GROUP BY c.owner""", ("class_info", "method_info"))
def f07_entry_counts(spark, sf):
    classes = bound(spark, sf, "class_info").where("side = 'target'").select(F.col("owner").alias("internal_name"), F.col("owner").endswith("9").alias("is_interface"), "access")
    methods = bound(spark, sf, "method_info").where("side = 'target'").withColumn("is_abstract", F.col("body_hash").isNull())
    return selection.entrypoint_counts(selection.entrypoint_classes(classes, ["o*"]), methods)


@query("f20_search_texts", """SELECT p_partkey, lower(concat_ws(' ', p_brand, p_name, p_type)) AS search_text FROM part""")
def f20_search_texts(spark, sf):
    return _part(spark, sf).select("p_partkey", K.search_text(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("search_text"))


@query("f21_resolution_details", """ SELECT module_key, seq, concat_ws('; ', CASE WHEN m THEN concat('requested ', requested_version, ' → effective ', effective_version) END, CASE WHEN selected AND NOT m THEN CASE WHEN requested_version = sv THEN concat('requested ', requested_version, ' selected directly') ELSE concat('requested ', requested_version, ' → selected ', ss) END END,
 CASE WHEN selected AND m AND effective_version <> sv THEN concat('reported resolved ', ss) END, CASE WHEN NOT selected THEN CASE omitted_reason WHEN 'conflict' THEN concat('effective ', effective_version, ' → selected ', ss) WHEN 'duplicate' THEN concat('resolved ', ss, ' reused from an earlier duplicate') WHEN 'cycle' THEN concat('reported ', ss, '; cycle omitted') ELSE concat('reported ', ss, '; omitted') END END) AS detail
FROM (SELECT *, trim(managed_from_version) <> '' AS m, selected_version AS sv, CASE WHEN selected_version = '' THEN '—' ELSE selected_version END AS ss FROM occ)""", ("occ",))
def f21_resolution_details(spark, sf):
    names = ("requested_version", "effective_version", "selected_version", "managed_from_version", "selected", "omitted_reason")
    return bound(spark, sf, "occ").select("module_key", "seq", K.resolution_detail(*map(F.col, names)).alias("detail"))


@query("s29_scalars", """SELECT p_partkey, concat('a.b#', p_name, ':', CASE WHEN p_size % 3 = 0 THEN '()V' WHEN p_size % 3 = 1 THEN concat('()V → (', p_size, ')') ELSE concat('(', p_size, ')') END) AS signature, p_size % 7 BETWEEN 3 AND 5 AS supported, printf('%.1f MiB', p_size * 100000 / 1048576.0) AS size FROM part""")
def s29_scalars(spark, sf):
    size = F.col("p_size")
    shown = F.concat(F.lit("("), size, F.lit(")"))
    old, new = F.when(size % 3 < 2, "()V"), F.when(size % 3 == 0, F.lit("()V")).otherwise(shown)
    version = F.element_at(F.array(*map(F.lit, ["2.2.1", "3.0.5", "3.6.2", "3.6.3", "3.8.1", "3.9.11", "4.0.0"])), size % 7 + 1)
    return _part(spark, sf).select("p_partkey", K.changed_signature(F.lit("a/b"), F.col("p_name"), old, new).alias("signature"), K.maven_supported(version).alias("supported"), K.mebibytes(size.cast("long") * 100_000).alias("size"))


# --- evidence and members --------------------------------------------------------------------------------------------
@query("j08_constant_evidence", """, l AS (SELECT node, CASE node % 3 WHEN 0 THEN 'JDK' ELSE 'PROJECT' END AS origin, CASE WHEN name < 'n2' THEN 'forName' ELSE 'load' END AS call, CASE WHEN name < 'n2' THEN owner ELSE concat('svc', node % 25) END AS literal FROM refs),
g AS (SELECT DISTINCT service AS literal FROM registration WHERE side = 'baseline')
SELECT DISTINCT point_id, node, 'class_lookup' AS mechanism FROM l JOIN points p ON p.kind = 'CLASS_REMOVED' AND p.owner = l.literal WHERE origin <> 'JDK' AND call = 'forName'
UNION SELECT DISTINCT CAST(1000000 + CAST(substr(literal, 4) AS BIGINT) AS BIGINT), node, 'service_load' FROM l WHERE origin <> 'JDK' AND call = 'load' AND literal IN (SELECT literal FROM g) AND CAST(substr(literal, 4) AS BIGINT) % 2 = 0""", ("points", "refs", "registration"))
def j08_constant_evidence(spark, sf):
    refs, node, lookup = bound(spark, sf, "refs"), F.col("node"), F.col("name") < "n2"
    literals = refs.select("node", F.when(node % 3 == 0, "JDK").otherwise("PROJECT").alias("origin"), F.when(lookup, "forName").otherwise("load").alias("call"), F.when(lookup, F.col("owner")).otherwise(F.concat(F.lit("svc"), node % 25)).alias("literal"))
    services = spark.range(0, 26, 2).select((F.col("id") + 1_000_000).alias("point_id"), F.lit("SERVICE_PROVIDER_REGISTRATION_REMOVED").alias("kind"), F.concat(F.lit("svc"), "id").alias("owner"))
    points = bound(spark, sf, "points").select(F.col("point_id").cast("long").alias("point_id"), "kind", "owner").union(services)
    return impact.constant_evidence(literals, points, bound(spark, sf, "registration").where("side = 'baseline'"))


@query("j10_structural_evidence", """, f AS (SELECT DISTINCT concat('o', node % 30) AS referencing_class, CASE WHEN ref_kind = 'type' THEN concat(name, descriptor) ELSE name END AS member, owner AS changed_class FROM refs), n AS (SELECT DISTINCT node, owner, name, descriptor FROM refs)
SELECT DISTINCT point_id, node FROM f JOIN points p ON p.owner = f.changed_class AND p.kind IN ('CLASS_REMOVED', 'CLASS_ACCESS_NARROWED') JOIN n ON n.owner = f.referencing_class AND (NOT contains(member, '(') OR member = concat(n.name, n.descriptor))""", ("points", "refs"))
def j10_structural_evidence(spark, sf):
    refs = bound(spark, sf, "refs")
    member = F.when(F.col("ref_kind") == "type", F.concat("name", "descriptor")).otherwise(F.col("name"))
    references = refs.select(F.concat(F.lit("o"), F.col("node") % 30).alias("referencing_class"), member.alias("member"), F.col("owner").alias("changed_class")).distinct()
    return impact.structural_evidence(references, bound(spark, sf, "points"), refs.select("node", "owner", "name", "descriptor").distinct())


@query("a15_member_metrics", """, t AS (SELECT l_partkey AS point_id, CASE l_returnflag WHEN 'A' THEN 'impact' WHEN 'R' THEN 'structural' ELSE 'other' END AS path_kind FROM lineitem)
SELECT p.point_id, count(*) FILTER (path_kind = 'impact') AS impact, count(*) FILTER (path_kind = 'structural') AS structural FROM points p LEFT JOIN t USING (point_id) GROUP BY p.point_id""", ("points",))
def a15_member_metrics(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "impact").when(F.col("l_returnflag") == "R", "structural").otherwise("other")
    paths = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("point_id"), kind.alias("path_kind"))
    return impact.member_metrics(bound(spark, sf, "points"), paths)


@query("a16_affected", """, x AS (SELECT DISTINCT module, node FROM flow_node WHERE origin = 'PROJECT'), p AS (SELECT DISTINCT module, unnest([src, dst]) AS node FROM flow)
SELECT module, count(DISTINCT concat('o', node % 50, '|', 'n', node % 9, '|()')) AS methods, count(DISTINCT node % 50) AS classes FROM p JOIN x USING (module, node) GROUP BY module""", ("flow", "flow_node"))
def a16_affected(spark, sf):
    node = F.col("node")
    nodes = bound(spark, sf, "flow_node").select("module", "node", "origin", F.concat(F.lit("o"), node % 50).alias("owner"), F.concat(F.lit("n"), node % 9).alias("name"), F.lit("()").alias("descriptor"))
    return impact.affected(bound(spark, sf, "flow").select("module", F.array("src", "dst").alias("nodes")), nodes)


@query("a22_terminal_states", """SELECT c_nationkey, CASE WHEN count(*) FILTER (s = 'COMPARABLE') = 0 THEN 'FAILED' WHEN bool_or(i) THEN 'COMPLETED_WITH_ISSUES' ELSE 'SUCCESS' END AS state
FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 4 <> 1 AND c_custkey % 3 = 0 THEN 'COMPARABLE' ELSE 'UNAVAILABLE' END AS s, c_nationkey % 3 = 0 AND c_custkey % 5 = 0 AS i FROM customer) GROUP BY c_nationkey""")
def a22_terminal_states(spark, sf):
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey", F.when((nation % 4 != 1) & (key % 3 == 0), "COMPARABLE").otherwise("UNAVAILABLE").alias("status"), ((nation % 3 == 0) & (key % 5 == 0)).alias("has_issue"))
    return impact.diff_terminal_state(rows, ["c_nationkey"])


@query("a24_ratios", """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_partkey / (p_size % 10) END AS ratio FROM part""")
def a24_ratios(spark, sf):
    return _part(spark, sf).select("p_partkey", impact.ratio(F.col("p_partkey"), F.col("p_size") % 10).alias("ratio"))


@query("d14_text_identity", """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'UNKNOWN' WHEN p_size % 3 = 1 THEN 'DIFFERENT' ELSE 'IDENTICAL' END AS identity FROM part""")
def d14_text_identity(spark, sf):
    new = F.when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("\n\nx"))).otherwise(F.concat("p_name", F.lit("\r\nx")))
    old = F.when(F.col("p_size") % 9 != 0, F.concat("p_name", F.lit("\nx")))
    return _part(spark, sf).select("p_partkey", diff.text_identical(old, new).alias("identity"))


@query("d09_suppressed_bodies", """, s AS (SELECT DISTINCT owner, name, descriptor FROM method_info WHERE side = 'target' AND body_hash = 'h1'), b AS (SELECT * FROM method_info WHERE side = 'baseline'), t AS (SELECT * FROM method_info WHERE side = 'target'),
one AS (SELECT side, owner, name, min(descriptor) AS d FROM method_info GROUP BY ALL HAVING count(*) = 1), mv AS (SELECT x.owner, x.name FROM one x JOIN one y USING (owner, name) WHERE x.side = 'baseline' AND y.side = 'target' AND x.d <> y.d)
SELECT owner, name, b.descriptor AS new_descriptor FROM b JOIN t USING (owner, name, descriptor) WHERE b.body_hash <> t.body_hash AND NOT EXISTS (SELECT 1 FROM s WHERE s.owner = b.owner AND s.name = b.name AND s.descriptor = b.descriptor) AND NOT EXISTS (SELECT 1 FROM mv WHERE mv.owner = b.owner AND mv.name = b.name)""", ("method_info",))
def d09_suppressed_bodies(spark, sf):
    b, t = _sides(spark, sf, "method_info")
    rows = diff.method_diff(b, t, suppressed=t.where("body_hash = 'h1'").select("owner", "name", "descriptor"))
    return rows.where("kind = 'METHOD_BODY_CHANGED'").select("owner", "name", "new_descriptor")


# --- trees and graphs ------------------------------------------------------------------------------------------------
@query("s13_selected_tree")
def s13_selected_tree(spark, sf):
    """A tree of the parts (a node's parent is a quarter of it) for each of five modules."""
    key = F.col("p_partkey")
    scope = F.when(key % 11 == F.col("module") + 5, "test").otherwise("compile")
    parts = _part(spark, sf).withColumn("module", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = parts.select("module", key.alias("node"), F.when(key > 1, F.greatest(F.floor(key / 4), F.lit(1))).alias("parent"), key.alias("ord"), scope.alias("scope"), (key % 5 == 3).alias("reactor"))
    return normalize.selected_tree(rows)


ORACLE_SQL["s13_selected_tree"] = """WITH RECURSIVE n AS (SELECT m AS module, p_partkey AS node, CASE WHEN p_partkey > 1 THEN greatest(p_partkey // 4, 1) END AS parent, p_partkey % 11 = m + 5 AS bad, p_partkey % 5 = 3 AS reactor FROM part, range(5) t(m)),
w(module, node, place, above) AS (SELECT module, node, node, CAST(NULL AS BIGINT) FROM n WHERE parent IS NULL
UNION ALL SELECT n.module, n.node, CASE WHEN n.reactor THEN w.place ELSE n.node END, w.place FROM w JOIN n ON n.module = w.module AND n.parent = w.node AND NOT n.bad)
SELECT module, node, above AS parent FROM w WHERE place = node"""


@query("g03_simple_paths")
def g03_simple_paths(spark, sf):
    """All paths to the first nation over a graph of nations: every supplier's nation calls what its number leads to."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    edges = s.select(F.col("s_nationkey").cast("long").alias("src"), F.floor(F.col("s_nationkey") * (1 + F.col("s_suppkey") % 3) / 4).alias("dst")).distinct()
    return graph.simple_paths(edges, spark.createDataFrame([(0,)], "node long")).select("seed", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


ORACLE_SQL["g03_simple_paths"] = """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, CAST(floor(s_nationkey * (1 + s_suppkey % 3) / 4) AS BIGINT) AS dst FROM supplier),
w(node, path) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL SELECT e.src, list_prepend(e.src, w.path) FROM w JOIN e ON e.dst = w.node WHERE NOT list_contains(w.path, e.src))
SELECT CAST(0 AS BIGINT) AS seed, array_to_string(path, '>') AS path FROM w WHERE node NOT IN (SELECT dst FROM e)"""


@query("g04_dependency_scopes")
def g04_dependency_scopes(spark, sf):
    """Trees of parts for five modules: a quarter of a node is its parent; module 3 has a seed that is not there."""
    key = F.col("p_partkey")
    nodes = _part(spark, sf).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("module"), key.alias("node"), (key == 0).alias("is_root"), (key % 6 == 5).alias("reactor"), F.col("p_size").alias("size"))
    edges = nodes.where("node > 0").select("module", F.floor(F.col("node") / 4).alias("src"), F.col("node").alias("dst"))
    seeds = nodes.where("size = module + 1").select("module", "node").union(spark.createDataFrame([(3, -1)], "module int, node long"))
    return normalize.dependency_scopes(nodes, edges, seeds)


ORACLE_SQL["g04_dependency_scopes"] = """WITH RECURSIVE n AS (SELECT m AS module, p_partkey AS node, p_partkey % 6 = 5 AS reactor, p_size AS size FROM part, range(5) t(m)),
u(module, node) AS (SELECT module, node FROM n WHERE size = module + 1 UNION SELECT module, node // 4 FROM u WHERE node > 0)
SELECT CAST(n.module AS INT) AS module, n.node, CASE WHEN n.module = 3 OR u.node IS NOT NULL THEN 'REAL_IR' ELSE 'NO_OP' END AS body, CASE WHEN n.module = 3 THEN 'FULL' ELSE 'CHANGED_PATHS' END AS mode, CASE WHEN n.module = 3 THEN 'SEED_MISSING' END AS reason
FROM n LEFT JOIN u USING (module, node) WHERE NOT reactor AND n.node <> 0"""


@query("g02_graph_problems")
def g02_graph_problems(spark, sf):
    """A graph of the suppliers of each nation: a path, but for nations whose number breaks it in one way."""
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("module"), F.col("s_suppkey").alias("node"))
    w = s.groupBy("module").agg(F.array_sort(F.collect_list("node")).alias("all"))
    kind = F.col("module") % 5
    nodes = w.select("module", F.posexplode("all").alias("i", "node")).withColumn("is_root", (F.col("i") == 0) & (kind != 1) | (F.col("i") == 1) & (kind == 2)).select("module", "node", "is_root")
    step = F.transform(F.sequence(F.lit(2), F.greatest(F.size("all"), F.lit(2))), lambda i: F.struct(F.get("all", i - 2).alias("src"), F.get("all", i - 1).alias("dst")))
    edges = w.select("module", "all", F.explode(step).alias("e")).select("module", "all", "e.*").where("dst IS NOT NULL").select("module", "src", F.when((kind == 3) & (F.col("dst") == F.array_max("all")), -1).otherwise(F.col("dst")).alias("dst"))
    back = w.where((kind == 4) & (F.size("all") > 1)).select("module", F.array_max("all").alias("src"), F.array_min("all").alias("dst"))
    return graph.validate_occurrence_graph(nodes, edges.union(back))


ORACLE_SQL["g02_graph_problems"] = """SELECT s_nationkey AS module, CASE WHEN s_nationkey % 5 = 1 THEN 'ROOT_MISSING' WHEN n > 1 AND s_nationkey % 5 = 2 THEN 'MULTIPLE_ROOTS' WHEN n > 1 AND s_nationkey % 5 = 3 THEN 'EDGE_INCOMPLETE' WHEN n > 1 AND s_nationkey % 5 = 4 THEN 'CYCLE' END AS problem
FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)"""


# --- orders, joins back, providers -----------------------------------------------------------------------------------
@query("w09_first_changes", _FIRST + """, c AS (SELECT module_key, group_id, artifact_id, CASE WHEN NOT in_b THEN 0 WHEN NOT in_t THEN 1 ELSE 2 END AS change_order FROM j WHERE NOT in_b OR NOT in_t OR bv <> tv)
SELECT *, row_number() OVER (ORDER BY module_key, change_order, group_id, artifact_id) AS place FROM c""", ("occ",))
def w09_first_changes(spark, sf):
    """All changes with their place in the report's order."""
    b, t = _sides(spark, sf, "occ")
    changes = diff.dependency_changes(_first(b), _first(t), MODULE_KEY)
    ordered = diff.ordered_changes(changes, MODULE_KEY).select(*MODULE_KEY, "change_order")
    # rows of an ordered result are numbered within their partitions, and those follow each other
    at = ordered.withColumn("_at", F.monotonically_increasing_id())
    return report.running_sums(at, ["_at"], {"place": F.lit(1)}).drop("_at")


@query("w06_sorted_groups", """ SELECT group_id, artifact_id, module_key, seq, row_number() OVER (PARTITION BY group_id, artifact_id ORDER BY module_key, seq) AS nth FROM occ""", ("occ",))
def w06_sorted_groups(spark, sf):
    """Where the external sort has put each row of its group: the place among the rows as they come, not sorted again."""
    rows = report.sorted_groups(bound(spark, sf, "occ"), ["group_id", "artifact_id"], ["module_key", "seq"])
    came = step(rows.select("group_id", "artifact_id", "module_key", "seq", F.monotonically_increasing_id().alias("_at")))
    first = came.groupBy("group_id", "artifact_id").agg(F.min("_at").alias("_first"))
    return came.join(first, ["group_id", "artifact_id"]).select("group_id", "artifact_id", "module_key", "seq", (F.col("_at") - F.col("_first") + 1).alias("nth"))


@query("j12_pair_modules", _FIRST + """, c AS (SELECT module_key, concat(group_id, ':', artifact_id, ':', bv) AS old_coordinate, concat(group_id, ':', artifact_id, ':', tv) AS new_coordinate FROM j WHERE in_b AND in_t AND bv <> tv)
SELECT DISTINCT module_key, old_coordinate, new_coordinate, length(old_coordinate) % 5 AS n_points FROM c WHERE old_coordinate LIKE '%:a1%'""", ("occ",))
def j12_pair_modules(spark, sf):
    b, t = _sides(spark, sf, "occ")
    name = lambda v: F.concat_ws(":", "group_id", "artifact_id", v)
    changes = diff.dependency_changes(_first(b), _first(t), MODULE_KEY).where("change_type = 'VERSION_CHANGED'").withColumns({"old_coordinate": name("old_version"), "new_coordinate": name("new_version")})
    pairs = changes.where("old_coordinate LIKE '%:a1%'").select("old_coordinate", "new_coordinate").distinct().withColumn("n_points", F.length("old_coordinate") % 5)
    return selection.pair_modules(pairs, changes).select("module_key", "old_coordinate", "new_coordinate", "n_points")


@query("a11_text_risks", """, t AS (SELECT binary_name, digest, CASE WHEN scan_ord % 31 = 0 THEN NULL ELSE concat('t', scan_ord % 2) END AS text FROM class_def)
SELECT binary_name, CASE WHEN CASE WHEN count(*) = count(text) THEN count(DISTINCT text) ELSE count(DISTINCT digest) END > 1 THEN 'HIGH' ELSE 'LOW' END AS risk FROM t GROUP BY binary_name""", ("class_def",))
def a11_text_risks(spark, sf):
    text = F.when(F.col("scan_ord") % 31 != 0, F.concat(F.lit("t"), F.col("scan_ord") % 2))
    return ownership.text_risk(bound(spark, sf, "class_def").withColumn("text", text))


@query("d10_valid_providers")
def d10_valid_providers(spark, sf):
    """Every part is a class of one of ten artifacts, below a half and a fifth of itself, and offers what a seventh of it names."""
    key = F.col("p_partkey")
    rows = _part(spark, sf).select((F.col("p_size") % 3).alias("artifact"), key.alias("owner"), (key % 5 != 0).alias("is_public"), (key % 7 == 3).alias("is_abstract"), (key % 11 != 1).alias("has_constructor"))
    parents = rows.select("artifact", F.col("owner").alias("sub"), F.floor(F.col("owner") / 2).alias("super")).union(rows.select("artifact", "owner", F.floor(F.col("owner") / 5)))
    offers = rows.select("artifact", F.explode(F.array(F.floor(F.col("owner") / 4), F.floor(F.col("owner") / 10), F.floor(F.col("owner") / 3))).alias("service"), F.col("owner").alias("provider"))
    return diff.valid_providers(offers, rows, parents)


ORACLE_SQL["d10_valid_providers"] = """WITH RECURSIVE c AS (SELECT p_size % 3 AS artifact, p_partkey AS owner, p_partkey % 5 <> 0 AND p_partkey % 7 <> 3 AND p_partkey % 11 <> 1 AS usable FROM part),
u AS (SELECT artifact, owner AS sub, owner // 2 AS super FROM c UNION SELECT artifact, owner, owner // 5 FROM c),
w(artifact, provider, name) AS (SELECT artifact, owner, owner FROM c WHERE usable UNION SELECT w.artifact, w.provider, u.super FROM w JOIN u ON u.artifact = w.artifact AND u.sub = w.name)
SELECT DISTINCT w.artifact, w.name AS service, w.provider FROM w WHERE w.name IN (w.provider // 4, w.provider // 10, w.provider // 3)"""
