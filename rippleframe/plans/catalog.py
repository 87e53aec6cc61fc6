"""The registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.textdiff import unified_diff
from ..operators import diff, graph, impact, normalize, ownership, selection, topology, versions
from . import report
from .bindings import bound, bound_sql

MODULE_KEY = ["module_key", "group_id", "artifact_id"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (bound_sql(*uses) + sql if uses else sql).strip()
        return f

    return register


def _sides(spark, sf, name):
    rows = bound(spark, sf, name)
    return rows.where("side = 'baseline'").drop("side"), rows.where("side = 'target'").drop("side")


def _first(df):
    return diff.first_wins(df, MODULE_KEY, ["seq"]).select(*MODULE_KEY, F.col("requested_version").alias("version"), F.col("effective_scope").alias("scope"))


_FIRST = """
, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, module_key, group_id, artifact_id ORDER BY seq) AS rn FROM occ) WHERE rn = 1),
j AS (SELECT module_key, group_id, artifact_id, b.requested_version AS bv, t.requested_version AS tv, b.effective_scope AS bs, t.effective_scope AS ts, b.seq IS NOT NULL AS in_b, t.seq IS NOT NULL AS in_t
  FROM (SELECT * FROM f WHERE side = 'baseline') b FULL JOIN (SELECT * FROM f WHERE side = 'target') t USING (module_key, group_id, artifact_id))
"""


def _tree_diff(spark, sf):
    b, t = _sides(spark, sf, "occ")
    return diff.tree_diff(_first(b), _first(t), MODULE_KEY)


@query("d02_tree_diff_metrics", _FIRST + """
SELECT module_key, count(*) FILTER (NOT in_b) AS added, count(*) FILTER (NOT in_t) AS removed, count(*) FILTER (in_b AND in_t AND bv <> tv) AS version_changed,
       count(*) FILTER (in_b AND in_t AND bv = tv) AS resolved_unchanged, count(*) FILTER (in_b AND in_t AND bs <> ts) AS scope_changed FROM j GROUP BY module_key""", ("occ",))
def d02_tree_diff_metrics(spark, sf):
    return diff.diff_metrics(_tree_diff(spark, sf), ["module_key"])


@query("d02_tree_diff", _FIRST + """
SELECT module_key, group_id, artifact_id, CASE WHEN NOT in_b THEN 'ADDED' WHEN NOT in_t THEN 'REMOVED' WHEN bv = tv THEN 'RESOLVED_UNCHANGED' ELSE 'VERSION_CHANGED' END AS base_type,
       in_b AND in_t AND bs <> ts AS scope_changed, bv AS old_version, tv AS new_version FROM j""".replace("in_b AND in_t AND bs <> ts", "coalesce(in_b AND in_t AND bs <> ts, false)"), ("occ",))
def d02_tree_diff(spark, sf):
    return _tree_diff(spark, sf)


@query("q06_scope_changed_rows", _FIRST + """
SELECT module_key, group_id, artifact_id, old_version, new_version FROM (SELECT *, bv AS old_version, tv AS new_version FROM j WHERE in_b AND in_t AND bs <> ts)
ORDER BY module_key, group_id, artifact_id LIMIT 50 OFFSET 50""", ("occ",))
def q06_scope_changed_rows(spark, sf):
    q = report.ReportQuery(_tree_diff(spark, sf).where(report.change_filter("SCOPE_CHANGED"))).sorted(*MODULE_KEY).paged(50, 1)
    return q.result().select(*MODULE_KEY, "old_version", "new_version")


@query("d01_dependency_changes", _FIRST + """
SELECT module_key, group_id, artifact_id, CASE WHEN NOT in_b THEN 'ADDED' WHEN NOT in_t THEN 'REMOVED' ELSE 'VERSION_CHANGED' END AS change_type, bv AS old_version, tv AS new_version,
       CASE WHEN in_t THEN ts ELSE bs END AS scope, CASE WHEN NOT in_b THEN 0 WHEN NOT in_t THEN 1 ELSE 2 END AS change_order FROM j WHERE NOT in_b OR NOT in_t OR bv <> tv""", ("occ",))
def d01_dependency_changes(spark, sf):
    b, t = _sides(spark, sf, "occ")
    return diff.dependency_changes(_first(b), _first(t), MODULE_KEY)


_CHAIN = "SELECT DISTINCT side, module_key, artifact_id, list_value(concat(group_id, ':', artifact_id), concat('d', depth)) AS chain FROM occ"


@query("d03_chain_diff", f""", c AS ({_CHAIN}),
j AS (SELECT module_key, artifact_id, array_to_string(chain, '>') AS chain, b.m AS bm, t.m AS tm FROM (SELECT *, 1 AS m FROM c WHERE side = 'baseline') b FULL JOIN (SELECT *, 1 AS m FROM c WHERE side = 'target') t USING (module_key, artifact_id, chain))
SELECT module_key, artifact_id, chain, CASE WHEN bm IS NULL THEN 'ADDED' WHEN tm IS NULL THEN 'REMOVED' ELSE 'UNCHANGED' END AS status FROM j""", ("occ",))
def d03_chain_diff(spark, sf):
    path = F.array(F.lit("root"), F.concat_ws(":", "group_id", "artifact_id"), F.concat(F.lit("d"), "depth"))
    b, t = (s.withColumn("path", path) for s in _sides(spark, sf, "occ"))
    return diff.chain_diff(b, t, ["module_key", "artifact_id"]).withColumn("chain", F.array_join("chain", ">"))


@query("d04_comparability", """, s AS (SELECT side, group_id, bool_and(depth < 3 OR selected) AS ok FROM occ WHERE NOT (side = 'target' AND group_id = 'Brand#7') GROUP BY side, group_id)
SELECT group_id, CASE WHEN (b.side IS NOT NULL AND NOT b.ok) OR (t.side IS NOT NULL AND NOT t.ok) THEN 'UNAVAILABLE' WHEN b.side IS NOT NULL AND t.side IS NOT NULL THEN 'COMPARABLE' ELSE 'STRUCTURE_MISMATCH' END AS status
FROM (SELECT * FROM s WHERE side = 'baseline') b FULL JOIN (SELECT * FROM s WHERE side = 'target') t USING (group_id)""", ("occ",))
def d04_comparability(spark, sf):
    b, t = _sides(spark, sf, "occ")
    ok = lambda df: df.groupBy("group_id").agg(F.bool_and((F.col("depth") < 3) | F.col("selected")).alias("available"))
    return diff.comparability(ok(b), ok(t.where("group_id <> 'Brand#7'")), ["group_id"])


_RANK = "CASE {} WHEN 'PUBLIC' THEN 3 WHEN 'PROTECTED' THEN 2 WHEN 'PACKAGE_PRIVATE' THEN 1 ELSE 0 END"


@query("d05_class_diff", f""" SELECT owner, kind FROM (SELECT owner, CASE WHEN b.side IS NULL THEN 'CLASS_ADDED' WHEN t.side IS NULL THEN 'CLASS_REMOVED' WHEN {_RANK.format('t.access')} < {_RANK.format('b.access')} THEN 'CLASS_ACCESS_NARROWED' END AS kind
FROM (SELECT * FROM class_info WHERE side = 'baseline') b FULL JOIN (SELECT * FROM class_info WHERE side = 'target') t USING (owner)) WHERE kind IS NOT NULL""", ("class_info",))
def d05_class_diff(spark, sf):
    return diff.class_diff(*_sides(spark, sf, "class_info"))


@query("d06_method_diff", f""", sh AS (SELECT owner FROM method_info WHERE side = 'baseline' INTERSECT SELECT owner FROM method_info WHERE side = 'target'),
m AS (SELECT * FROM method_info WHERE owner IN (SELECT owner FROM sh)),
one AS (SELECT side, owner, name, min(descriptor) AS d FROM m GROUP BY ALL HAVING count(*) = 1),
mv AS (SELECT b.owner, b.name, b.d AS od, t.d AS nd FROM one b JOIN one t ON b.owner = t.owner AND b.name = t.name AND b.side = 'baseline' AND t.side = 'target' AND b.d <> t.d),
j AS (SELECT owner, name, descriptor, b.side AS bs, t.side AS ts, b.access AS ba, t.access AS ta, b.body_hash AS bh, t.body_hash AS th FROM (SELECT * FROM m WHERE side = 'baseline') b FULL JOIN (SELECT * FROM m WHERE side = 'target') t USING (owner, name, descriptor)),
k AS (SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.owner = j.owner AND mv.name = j.name))
SELECT owner, name, 'METHOD_ADDED' AS kind, NULL AS old_descriptor, descriptor AS new_descriptor FROM k WHERE bs IS NULL
UNION ALL SELECT owner, name, 'METHOD_REMOVED', descriptor, NULL FROM k WHERE ts IS NULL
UNION ALL SELECT owner, name, 'METHOD_BODY_CHANGED', descriptor, descriptor FROM k WHERE bs IS NOT NULL AND ts IS NOT NULL AND bh <> th
UNION ALL SELECT owner, name, 'METHOD_ACCESS_NARROWED', descriptor, descriptor FROM k WHERE bs IS NOT NULL AND ts IS NOT NULL AND {_RANK.format('ta')} < {_RANK.format('ba')}
UNION ALL SELECT owner, name, 'METHOD_DESCRIPTOR_CHANGED', od, nd FROM mv""", ("method_info",))
def d06_method_diff(spark, sf):
    return diff.method_diff(*_sides(spark, sf, "method_info"))


@query("d08_field_diff", f""", sh AS (SELECT owner FROM field_info WHERE side = 'baseline' INTERSECT SELECT owner FROM field_info WHERE side = 'target'),
m AS (SELECT * FROM field_info WHERE owner IN (SELECT owner FROM sh))
SELECT * FROM (SELECT owner, name, CASE WHEN b.side IS NULL THEN 'FIELD_ADDED' WHEN t.side IS NULL THEN 'FIELD_REMOVED' WHEN b.descriptor <> t.descriptor THEN 'FIELD_DESCRIPTOR_CHANGED'
  WHEN {_RANK.format('t.access')} < {_RANK.format('b.access')} THEN 'FIELD_ACCESS_NARROWED' END AS kind, b.descriptor AS old_descriptor, t.descriptor AS new_descriptor
  FROM (SELECT * FROM m WHERE side = 'baseline') b FULL JOIN (SELECT * FROM m WHERE side = 'target') t USING (owner, name)) WHERE kind IS NOT NULL""", ("field_info",))
def d08_field_diff(spark, sf):
    return diff.field_diff(*_sides(spark, sf, "field_info"))


@query("d10_removed_registrations", """, rem AS (SELECT owner FROM class_info WHERE side = 'baseline' EXCEPT SELECT owner FROM class_info WHERE side = 'target')
SELECT service, provider, provider IN (SELECT owner FROM rem) AS suppressed FROM (SELECT service, provider FROM registration WHERE side = 'baseline' EXCEPT SELECT service, provider FROM registration WHERE side = 'target')
WHERE provider IN (SELECT owner FROM class_info WHERE side = 'baseline' AND access = 'PUBLIC')""", ("registration", "class_info"))
def d10_removed_registrations(spark, sf):
    b, t = _sides(spark, sf, "registration")
    cb, ct = _sides(spark, sf, "class_info")
    gone = diff.class_diff(cb, ct).where("kind = 'CLASS_REMOVED'")
    return diff.removed_registrations(b, t, cb.where("access = 'PUBLIC'").select(F.col("owner").alias("provider")), gone)


@query("d11_text_diff")
def d11_text_diff(spark, sf):
    """Unified difference of each document and the next one of its source, over whole texts; null where there is none."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 20).alias("doc_id"), F.col("text").alias("new_text"))
    return docs.join(after, "doc_id", "left").select("doc_id", unified_diff("text", "new_text").alias("difference"))


@query("d04_gated_metrics", _FIRST + """, s AS (SELECT module_key, bool_and(side <> 'target' OR l <> 'm3') AND bool_and(NOT (omitted_reason = 'cycle' AND depth = 3 AND module_key LIKE '%7')) AS ok, count(DISTINCT side) AS sides FROM (SELECT *, module_key AS l FROM occ) GROUP BY module_key),
st AS (SELECT module_key, CASE WHEN NOT ok THEN 'UNAVAILABLE' WHEN sides = 2 THEN 'COMPARABLE' ELSE 'STRUCTURE_MISMATCH' END AS status FROM s)
SELECT st.module_key, status, CASE WHEN status = 'COMPARABLE' THEN count(*) FILTER (NOT in_b) END AS added, CASE WHEN status = 'COMPARABLE' THEN count(*) FILTER (NOT in_t) END AS removed,
       CASE WHEN status = 'COMPARABLE' THEN count(*) FILTER (in_b AND in_t AND bv <> tv) END AS version_changed, CASE WHEN status = 'COMPARABLE' THEN count(*) FILTER (in_b AND in_t AND bv = tv) END AS resolved_unchanged,
       CASE WHEN status = 'COMPARABLE' THEN count(*) FILTER (in_b AND in_t AND bs <> ts) END AS scope_changed FROM st JOIN j USING (module_key) GROUP BY st.module_key, status""", ("occ",))
def d04_gated_metrics(spark, sf):
    occ = bound(spark, sf, "occ")
    bad = (F.col("omitted_reason") == "cycle") & (F.col("depth") == 3) & F.col("module_key").endswith("7")
    b, t = (occ.where(f"side = '{s}'").groupBy("module_key").agg(F.bool_and(~bad).alias("available")) for s in ("baseline", "target"))
    t = t.withColumn("available", F.col("available") & (F.col("module_key") != "m3"))
    return diff.gated_metrics(_tree_diff(spark, sf), diff.comparability(b, t, ["module_key"]), ["module_key"])


@query("a03_total_metrics", _FIRST + """SELECT count(DISTINCT module_key) AS modules, count(*) FILTER (NOT in_b) AS added, count(*) FILTER (NOT in_t) AS removed, count(*) FILTER (in_b AND in_t AND bv <> tv) AS version_changed,
       count(*) FILTER (in_b AND in_t AND bv = tv) AS resolved_unchanged, count(*) FILTER (in_b AND in_t AND bs <> ts) AS scope_changed FROM j WHERE module_key <> 'm5'""", ("occ",))
def a03_total_metrics(spark, sf):
    rows = _tree_diff(spark, sf)
    statuses = rows.select("module_key").distinct().withColumn("status", F.when(F.col("module_key") == "m5", "UNAVAILABLE").otherwise("COMPARABLE"))
    return diff.total_metrics(diff.gated_metrics(rows, statuses, ["module_key"]))


@query("a02_dependency_aggregate", """, p AS (SELECT side, module_key, group_id, artifact_id, path, arg_max(effective_version, seq) AS v, arg_max(effective_scope, seq) AS sc FROM occ GROUP BY ALL),
q AS (SELECT side, module_key, group_id, artifact_id, count(*) AS n_paths, string_agg(concat(path, ':', v, ':', sc), ', ' ORDER BY path) AS paths FROM p GROUP BY ALL),
o AS (SELECT side, module_key, group_id, artifact_id, arg_min(selected_version, seq) AS selected_version, arg_min(effective_scope, seq) AS effective_scope, bool_or(depth = 1) AS direct FROM occ GROUP BY ALL)
SELECT * FROM o JOIN q USING (side, module_key, group_id, artifact_id)""", ("occ",))
def a02_dependency_aggregate(spark, sf):
    rows = versions.aggregate_dependencies(bound(spark, sf, "occ"), ["side", "module_key"])
    return rows.withColumn("paths", F.array_join(F.transform("paths", lambda p: F.concat_ws(":", p["path"], p["version"], p["scope"])), ", "))


_CONFLICTS = """, v AS (SELECT *, unnest(list_distinct([requested_version, CASE WHEN trim(managed_from_version) <> '' THEN effective_version ELSE requested_version END])) AS v FROM occ),
conf AS (SELECT side, module_key, group_id, artifact_id, count(DISTINCT v) AS n_versions, arg_min(selected_version, CASE WHEN selected THEN 0 ELSE 1 END * 100000000 + seq) AS reported_version,
  arg_min(effective_scope, CASE WHEN selected THEN 0 ELSE 1 END * 100000000 + seq) AS reported_scope, count(DISTINCT concat(path, '|', v)) AS version_paths FROM v WHERE trim(v) <> '' GROUP BY ALL HAVING count(DISTINCT v) > 1)
"""


@query("a04_internal_conflicts", _CONFLICTS + "SELECT * FROM conf", ("occ",))
def a04_internal_conflicts(spark, sf):
    return versions.internal_conflicts(bound(spark, sf, "occ"), ["side", "module_key"])


_RESOLVED = "SELECT {by}, count(DISTINCT CASE WHEN selected AND trim(selected_version) <> '' THEN selected_version END) AS resolved, count(DISTINCT CASE WHEN trim(v) <> '' THEN v END) AS unique_versions FROM (SELECT *, unnest([requested_version, selected_version]) AS v FROM occ) GROUP BY ALL"


@query("a05_resolved_versions", " " + _RESOLVED.format(by="group_id, artifact_id"), ("occ",))
def a05_resolved_versions(spark, sf):
    return versions.resolved_versions(bound(spark, sf, "occ"), versions.KEY)


@query("a08_module_catalog", " " + _RESOLVED.format(by="module_key, group_id, artifact_id"), ("occ",))
def a08_module_catalog(spark, sf):
    return versions.resolved_versions(bound(spark, sf, "occ"), MODULE_KEY)


@query("a07_multi_version", f""", r AS ({_RESOLVED.format(by="group_id, artifact_id")})
SELECT module_key, count(DISTINCT CASE WHEN r.resolved > 1 THEN concat(o.group_id, ':', o.artifact_id) END) AS multi_version, count(DISTINCT concat(o.group_id, ':', o.artifact_id)) AS selected_keys
FROM occ o JOIN r USING (group_id, artifact_id) WHERE selected GROUP BY module_key""", ("occ",))
def a07_multi_version(spark, sf):
    return versions.multi_version_by_module(bound(spark, sf, "occ"), ["module_key"])


_CLASS_CONFLICTS = "SELECT binary_name, count(*) AS candidates, CASE WHEN count(DISTINCT digest) > 1 THEN 'HIGH' ELSE 'LOW' END AS risk FROM (SELECT DISTINCT binary_name, origin, source_key, digest, entry_name FROM class_def) GROUP BY binary_name HAVING count(*) > 1"


@query("a09_reactor_summary", _CONFLICTS + f""", r AS ({_RESOLVED.format(by="group_id, artifact_id")}), cc AS ({_CLASS_CONFLICTS})
SELECT (SELECT count(DISTINCT module_key) FROM occ) AS modules, (SELECT count(*) FROM occ) AS occurrences, (SELECT count(*) FROM conf) AS internal_conflicts, (SELECT count(*) FROM r WHERE resolved > 1) AS multi_version,
       (SELECT count(*) FROM cc) AS class_conflicts, (SELECT count(*) FROM cc WHERE risk = 'HIGH') AS high_class_conflicts""", ("occ", "class_def"))
def a09_reactor_summary(spark, sf):
    occ = bound(spark, sf, "occ")
    return versions.reactor_summary(occ, versions.internal_conflicts(occ, ["side", "module_key"]), ownership.class_conflicts(bound(spark, sf, "class_def")))


@query("a10_class_conflicts", " " + _CLASS_CONFLICTS, ("class_def",))
def a10_class_conflicts(spark, sf):
    return ownership.class_conflicts(bound(spark, sf, "class_def"))


_WIN = "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY binary_name ORDER BY CASE origin WHEN 'JDK' THEN 0 WHEN 'PROJECT' THEN 1 WHEN 'REACTOR_DEPENDENCY' THEN 2 WHEN 'DEPENDENCY' THEN 3 ELSE 4 END, scan_ord, source_key, digest) AS rn FROM class_def) WHERE rn = 1)"


@query("w01_class_winners", f", {_WIN} SELECT binary_name, origin FROM w", ("class_def",))
def w01_class_winners(spark, sf):
    return ownership.class_winners(bound(spark, sf, "class_def")).select("binary_name", "origin")


@query("f14_effective_definitions", f", {_WIN} SELECT d.binary_name, d.origin, d.entry_name FROM class_def d JOIN w ON d.binary_name = w.binary_name AND d.source_key = w.source_key", ("class_def",))
def f14_effective_definitions(spark, sf):
    return ownership.effective_definitions(bound(spark, sf, "class_def")).select("binary_name", "origin", "entry_name")


@query("j14_shadowed_changes", f""", {_WIN}, pts AS (SELECT DISTINCT binary_name AS owner, source_key AS artifact FROM class_def)
SELECT DISTINCT p.owner, p.artifact FROM pts p JOIN w ON p.owner = w.binary_name WHERE p.artifact <> w.source_key""", ("class_def",))
def j14_shadowed_changes(spark, sf):
    defs = bound(spark, sf, "class_def")
    return ownership.shadowed_changes(defs.select(F.col("binary_name").alias("owner"), F.col("source_key").alias("artifact")).distinct(), defs)


@query("f05_artifact_selection", """ SELECT DISTINCT group_id, artifact_id FROM occ WHERE (regexp_full_match(concat(group_id, ':', artifact_id), 'Brand#1.*:a.') OR regexp_full_match(concat(group_id, ':', artifact_id), 'Brand#2:.*'))
AND NOT regexp_full_match(concat(group_id, ':', artifact_id), '.*:a7')""", ("occ",))
def f05_artifact_selection(spark, sf):
    occ = bound(spark, sf, "occ").select("group_id", "artifact_id").distinct()
    return occ.where(K.artifact_selected(F.concat_ws(":", "group_id", "artifact_id"), ["Brand#1*:a?", "Brand#2:*"], ["*:a7"]))


@query("f06_entrypoint_selection", """ SELECT c_custkey, concat('com/', c_mktsegment, '/n', c_nationkey, '/', replace(c_name, '#', '$')) AS internal_name FROM customer
WHERE (c_mktsegment LIKE 'B%' AND c_nationkey >= 10) OR c_mktsegment = 'MACHINERY'""")
def f06_entrypoint_selection(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    c = c.select("c_custkey", F.concat(F.lit("com/"), "c_mktsegment", F.lit("/n"), "c_nationkey", F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("$"))).alias("internal_name"))
    return c.where(K.entrypoint_selected(F.col("internal_name"), ["com/B*/n??/Customer$*", "com/MACHINERY/**"], []))


@query("f01_coordinates", """ SELECT p_partkey, p_brand AS group_id, p_name AS artifact_id, CASE WHEN p_size % 3 = 2 THEN concat('v', p_size) ELSE concat('v', p_size) END AS version, CASE WHEN p_size % 3 = 2 THEN p_type ELSE '' END AS classifier FROM part""")
def f01_coordinates(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    v = F.concat(F.lit("v"), "p_size")
    label = F.when(F.col("p_size") % 3 == 2, F.concat_ws(":", "p_brand", "p_name", F.lit("jar"), "p_type", v, F.lit("compile"))).when(F.col("p_size") % 3 == 1, F.concat_ws(":", "p_brand", "p_name", F.lit("jar"), v, F.lit("x"))).otherwise(F.concat_ws(":", "p_brand", "p_name", F.lit("jar"), v))
    c = K.coordinate_parts(label)
    return p.select("p_partkey", c["group_id"].alias("group_id"), c["artifact_id"].alias("artifact_id"), c["version"].alias("version"), c["classifier"].alias("classifier"))


@query("f17_jdk_ranges", """ SELECT p_partkey, (p_size % 20 >= 8 AND p_size % 20 < 17) AS in_range, NOT starts_with(concat('1.', p_size % 20), '1.8') AS not_prefix FROM part""")
def f17_jdk_ranges(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    jdk = F.concat(F.lit("1."), F.col("p_size") % 20)
    return p.select("p_partkey", K.jdk_in_range(F.lit("[1.8,1.17)"), jdk).alias("in_range"), K.jdk_in_range(F.lit("!1.8"), jdk).alias("not_prefix"))


@query("f21_resolution_sources", """ SELECT seq, module_key, CASE WHEN trim(managed_from_version) <> '' THEN 'Dependency management' || CASE WHEN selected THEN '' ELSE ' → ' || how END WHEN selected THEN 'Direct selection' ELSE how END AS source
FROM (SELECT *, CASE omitted_reason WHEN 'conflict' THEN 'Conflict mediation' WHEN 'duplicate' THEN 'Duplicate mediation' WHEN 'cycle' THEN 'Cycle omission' ELSE 'Maven omission' END AS how FROM occ)""", ("occ",))
def f21_resolution_sources(spark, sf):
    return bound(spark, sf, "occ").select("seq", "module_key", K.resolution_source(F.col("managed_from_version"), F.col("selected"), F.col("omitted_reason")).alias("source"))


@query("f22_access_check", """ SELECT request_id, CASE WHEN access = 'PUBLIC' THEN 'ACCESSIBLE:PUBLIC_ACCESS' WHEN access = 'PRIVATE' AND caller = declaring THEN 'ACCESSIBLE:DECLARING_CLASS' WHEN access = 'PRIVATE' THEN 'INACCESSIBLE:PRIVATE_MEMBER'
 WHEN split_part(caller, '/', 1) = split_part(declaring, '/', 1) THEN 'ACCESSIBLE:SAME_RUNTIME_PACKAGE' WHEN access = 'PACKAGE_PRIVATE' THEN 'INACCESSIBLE:DIFFERENT_RUNTIME_PACKAGE' WHEN NOT caller_sub THEN 'INACCESSIBLE:PROTECTED_CALLER_NOT_SUBCLASS'
 WHEN NOT owner_related THEN 'INACCESSIBLE:PROTECTED_SYMBOLIC_OWNER' WHEN NOT is_instance THEN 'ACCESSIBLE:PROTECTED_STATIC_SUBCLASS' WHEN receiver_kind IN ('THIS', 'SUPER') THEN concat('ACCESSIBLE:PROTECTED_', receiver_kind, '_RECEIVER')
 WHEN receiver_kind IN ('POINT', 'CONE') AND receiver_assignable THEN 'ACCESSIBLE:PROTECTED_RECEIVER_ASSIGNABLE' WHEN receiver_kind = 'POINT' THEN 'INACCESSIBLE:PROTECTED_RECEIVER_NOT_ASSIGNABLE' ELSE 'POTENTIALLY_INACCESSIBLE:PROTECTED_RECEIVER_UNKNOWN' END AS decision FROM access_facts""", ("access_facts",))
def f22_access_check(spark, sf):
    a = bound(spark, sf, "access_facts")
    names = ("caller", "declaring", "access", "is_instance", "receiver_kind", "caller_sub", "owner_related", "receiver_assignable")
    return a.select("request_id", impact.access_decision(*map(F.col, names)).alias("decision"))


@query("f23_pruned_edges", """ SELECT module, caller_id, callee_id FROM sites GROUP BY ALL HAVING bool_and(coalesce(is_dispatch AND n_targets > 1 AND receiver_verdict = 'EXCLUDES', false))""", ("sites",))
def f23_pruned_edges(spark, sf):
    return impact.pruned_edges(bound(spark, sf, "sites"))


@query("j07_evidence", """, m AS (SELECT point_id, kind, owner, name, unnest(CASE WHEN kind IN ('METHOD_REMOVED', 'METHOD_DESCRIPTOR_CHANGED') THEN [old_descriptor] WHEN kind LIKE 'FIELD%' THEN list_distinct([old_descriptor, new_descriptor]) ELSE [new_descriptor] END) AS descriptor FROM points WHERE kind NOT LIKE 'CLASS%')
SELECT DISTINCT point_id, kind, ref_kind, node FROM refs r JOIN m USING (owner, name, descriptor) WHERE (ref_kind = 'invoke' AND kind IN ('METHOD_REMOVED', 'METHOD_DESCRIPTOR_CHANGED', 'METHOD_ACCESS_NARROWED')) OR (ref_kind = 'field' AND kind LIKE 'FIELD%') OR (ref_kind = 'declaration' AND kind = 'METHOD_BODY_CHANGED')
UNION SELECT DISTINCT point_id, kind, ref_kind, node FROM refs r JOIN points p USING (owner) WHERE ref_kind = 'type' AND kind IN ('CLASS_REMOVED', 'CLASS_ACCESS_NARROWED')""", ("points", "refs"))
def j07_evidence(spark, sf):
    return impact.evidence(bound(spark, sf, "refs"), impact.graph_relevant(bound(spark, sf, "points")))


@query("g08_reverse_reach")
def g08_reverse_reach(spark, sf):
    return graph.reach(bound(spark, sf, "edge1"), spark.createDataFrame([(1,)], "node long"), reverse=True).select("node")


def _edge1_sql(sql: str) -> str:
    from .bindings import BINDINGS, TABLES

    return f"WITH RECURSIVE edge1 AS ({BINDINGS['edge1'].format(**{t: t for t in TABLES})}), {sql}"


ORACLE_SQL["g08_reverse_reach"] = _edge1_sql("r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.src FROM edge1 e JOIN r ON e.dst = r.node) SELECT node FROM r")


def _edge_frame(spark, sf):
    return bound(spark, sf, "edge1").select(F.lit(0).alias("module"), "src", "dst")


@query("g08_shortest_levels")
def g08_shortest_levels(spark, sf):
    return graph.reverse_paths(_edge_frame(spark, sf), spark.createDataFrame([(0, 1)], "module int, node long")).select("node", "level")


ORACLE_SQL["g08_shortest_levels"] = _edge1_sql("r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT e.src, r.level + 1 FROM edge1 e JOIN r ON e.dst = r.node WHERE r.level < 60) SELECT node, min(level) AS level FROM r GROUP BY node")


@query("g09_strong_components")
def g09_strong_components(spark, sf):
    return graph.strong_components(_edge_frame(spark, sf)).select("node", "component", F.col("size").cast("long").alias("size"), "cyclic")


ORACLE_SQL["g09_strong_components"] = _edge1_sql("""n AS (SELECT src AS node FROM edge1 UNION SELECT dst FROM edge1),
r(a, b) AS (SELECT src, dst FROM edge1 UNION SELECT r.a, e.dst FROM r JOIN edge1 e ON r.b = e.src),
c AS (SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS component, count(*) FILTER (x.b = n.node) > 0 AS cyclic FROM n LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON x.a = n.node GROUP BY n.node)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size, cyclic FROM c""")


_DEGREES = """ d AS (SELECT e.module, e.src AS node, count(DISTINCT e.dst) AS related_nodes, count(DISTINCT g.method) AS related_methods, CAST(sum(e.n_sites) AS BIGINT) AS raw_edges FROM flow e JOIN flow_node g ON g.module = e.module AND g.node = e.dst GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY module ORDER BY related_nodes DESC, related_methods DESC, raw_edges DESC, node) AS INT) AS rank FROM d)"""


def _flow(spark, sf):
    """The stand-in call graph, an edge for each of its sites, and its nodes."""
    edges = bound(spark, sf, "flow")
    return edges.withColumn("_site", F.explode(F.sequence(F.lit(1), F.col("n_sites")))).select("module", "src", "dst"), bound(spark, sf, "flow_node")


@query("a12_top_degrees", "," + _DEGREES + "SELECT module, node, related_nodes, related_methods, raw_edges, rank FROM k WHERE rank <= 10", ("flow", "flow_node"))
def a12_top_degrees(spark, sf):
    return topology.top_ranked(*_flow(spark, sf))


@query("a13_related_methods", "," + _DEGREES + """, m AS (SELECT e.module, e.src AS node, g.method, count(DISTINCT e.dst) AS related_nodes, string_agg(DISTINCT CAST(e.dst AS VARCHAR), ',' ORDER BY CAST(e.dst AS VARCHAR)) AS nodes
  FROM flow e JOIN flow_node g ON g.module = e.module AND g.node = e.dst JOIN k ON k.module = e.module AND k.node = e.src AND k.rank <= 10 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY module, node ORDER BY related_nodes DESC, method) AS INT) AS rank FROM m) WHERE rank <= 10""", ("flow", "flow_node"))
def a13_related_methods(spark, sf):
    edges, nodes = _flow(spark, sf)
    rows = topology.related_methods(edges, nodes, topology.top_ranked(edges, nodes))
    return rows.withColumn("nodes", F.array_join(F.array_sort(F.transform("nodes", lambda x: x.cast("string"))), ","))


@query("g12_representative_paths", """, p AS (SELECT o_custkey % 60 AS point_id, o_orderkey % 7 AS root, [o_orderkey % 7, o_orderkey % 11, o_custkey % 13][1:1 + CAST(o_orderkey % 3 AS INT)] AS nodes, o_orderpriority AS evidence_key FROM orders)
SELECT point_id, root, CAST(len(nodes) AS INT) AS length, array_to_string(nodes, '>') AS nodes, evidence_key FROM (SELECT *, row_number() OVER (PARTITION BY point_id, root ORDER BY len(nodes), nodes, evidence_key) AS rn FROM p) WHERE rn = 1""".replace(", p AS", "WITH p AS", 1))
def g12_representative_paths(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    nodes = F.slice(F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 11, F.col("o_custkey") % 13), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))
    p = o.select((F.col("o_custkey") % 60).alias("point_id"), (F.col("o_orderkey") % 7).alias("root"), nodes.alias("nodes"), F.col("o_orderpriority").alias("evidence_key"))
    return impact.representative_paths(p).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))


@query("g14_dispositions", """, e AS (SELECT point_id, count(*) FILTER (node % 5 = 0) > 0 AS path, count(*) FILTER (node % 5 = 1) > 0 AS seeds FROM (SELECT p.point_id, r.node FROM points p JOIN refs r USING (owner, name)) GROUP BY point_id)
SELECT point_id, CASE WHEN kind = 'METHOD_ADDED' THEN 'CHANGE_KIND_NOT_ANALYZED' WHEN point_id % 17 = 0 THEN 'SHADOWED_BY_DUPLICATE' WHEN coalesce(path, false) THEN 'IMPACT_REPORTED' WHEN coalesce(seeds, false) THEN 'NO_PROJECT_PATH' WHEN point_id % 5 = 0 THEN 'UNREACHABLE_STRUCTURAL_REFERENCE'
 WHEN kind LIKE '%\\_ACCESS\\_NARROWED' ESCAPE '\\' AND point_id % 2 = 0 THEN 'ACCESS_REMAINS_VALID' WHEN kind = 'METHOD_BODY_CHANGED' THEN 'TARGET_NOT_FOUND' ELSE 'DECLARED_REFERENCE_NOT_FOUND' END AS disposition FROM points LEFT JOIN e USING (point_id)""", ("points", "refs"))
def g14_dispositions(spark, sf):
    points = bound(spark, sf, "points")
    place = ["owner", "name"]
    at = bound(spark, sf, "refs").groupBy(*place).agg(F.bool_or(F.col("node") % 5 == 0).alias("path"), F.bool_or(F.col("node") % 5 == 1).alias("seeds"))
    e = points.select("point_id", *place).join(at, place).groupBy("point_id").agg(F.bool_or("path").alias("path"), F.bool_or("seeds").alias("seeds"))
    no = F.lit(False)
    value = impact.disposition(F.col("kind"), F.col("kind") != "METHOD_ADDED", F.col("point_id") % 17 == 0, F.coalesce("path", no), F.coalesce("seeds", no), F.col("point_id") % 5 == 0, F.col("point_id") % 2 == 0)
    return points.join(e, "point_id", "left").select("point_id", value.alias("disposition"))


@query("a20_coverage_reason", """SELECT c_nationkey, coalesce(arg_min(reason, rk), 'NONE') AS reason FROM (SELECT c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'REFLECTION' WHEN 'AUTOMOBILE' THEN 'INVOKEDYNAMIC' WHEN 'FURNITURE' THEN 'BODY_BOUNDARY' ELSE 'SCOPE_VALIDATION' END AS reason,
 CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 5 WHEN 'AUTOMOBILE' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 6 END AS rk FROM customer) GROUP BY c_nationkey""")
def a20_coverage_reason(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    reason = F.when(F.col("c_mktsegment") == "MACHINERY", "REFLECTION").when(F.col("c_mktsegment") == "AUTOMOBILE", "INVOKEDYNAMIC").when(F.col("c_mktsegment") == "FURNITURE", "BODY_BOUNDARY").when(F.col("c_mktsegment") != "BUILDING", "SCOPE_VALIDATION")
    return impact.coverage_reason(c.select("c_nationkey", reason.alias("reason")), ["c_nationkey"])


@query("a21_overall_status", """SELECT c_nationkey, CASE WHEN count(*) FILTER (status = 'FAILED') > 0 AND count(*) FILTER (status IN ('COMPLETED', 'INCONCLUSIVE')) > 0 THEN 'PARTIAL_SUCCESS' WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (status = 'INCONCLUSIVE') > 0 THEN 'INCONCLUSIVE' ELSE 'SUCCESS' END AS status
FROM (SELECT c_nationkey, CASE WHEN c_custkey % 150 = 0 THEN 'FAILED' WHEN c_custkey % 90 = 1 THEN 'INCONCLUSIVE' WHEN c_custkey % 3 = 0 THEN 'SKIPPED' ELSE 'COMPLETED' END AS status FROM customer) GROUP BY c_nationkey""")
def a21_overall_status(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    s = F.when(F.col("c_custkey") % 150 == 0, "FAILED").when(F.col("c_custkey") % 90 == 1, "INCONCLUSIVE").when(F.col("c_custkey") % 3 == 0, "SKIPPED").otherwise("COMPLETED")
    return impact.overall_status(c.select("c_nationkey", s.alias("status")), ["c_nationkey"])


@query("a23_sample_summary", """SELECT event_type, min(value) AS min_value, median(value) AS median_value, max(value) AS max_value, count(*) AS samples, arg_min(user_id, event_id) AS user_id FROM events GROUP BY event_type""")
def a23_sample_summary(spark, sf):
    return impact.sample_summary(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], "value", ("user_id",), "event_id")


@query("w04_id_ranges", """SELECT l_suppkey, min(l_orderkey) AS start, count(*) AS n FROM (SELECT l_suppkey, l_orderkey, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS island FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) GROUP BY l_suppkey, island""")
def w04_id_ranges(spark, sf):
    return report.id_ranges(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_suppkey"], "l_orderkey")


@query("q09_merged_ranges", """, m AS (SELECT *, max(stop) OVER (PARTITION BY g ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (SELECT DISTINCT o_custkey % 50 AS g, o_orderkey AS start, o_orderkey + 1 + o_orderkey % 60 AS stop FROM orders)),
r AS (SELECT *, sum(CASE WHEN start > coalesce(p, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT g, min(start) AS start, max(stop) AS stop FROM r GROUP BY g, run""".replace(", m AS", "WITH m AS", 1))
def q09_merged_ranges(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1 + F.col("o_orderkey") % 60).alias("stop")).distinct()
    return report.merged_ranges(o, ["g"])


@query("w05_dense_ids", """SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS id FROM (SELECT DISTINCT p_brand, p_type FROM part)""")
def w05_dense_ids(spark, sf):
    return report.dense_ids(spark.read.parquet(f"{sf}/part.parquet"), ["p_brand", "p_type"])


@query("q01_dependency_table", """ SELECT seq, module_key, group_id, artifact_id FROM occ WHERE effective_scope = 'runtime' AND contains(lower(concat_ws(' ', group_id, artifact_id)), '#1') ORDER BY group_id, artifact_id, module_key, seq LIMIT 100 OFFSET 100""", ("occ",))
def q01_dependency_table(spark, sf):
    occ = bound(spark, sf, "occ").withColumn("search_text", K.search_text(F.col("group_id"), F.col("artifact_id")))
    q = report.ReportQuery(occ, known={"effective_scope": set(K.SCOPES)}).exact("effective_scope", "runtime").search("#1", "search_text")
    return q.sorted("group_id", "artifact_id", "module_key", "seq").paged(100, 1).result().select("seq", "module_key", "group_id", "artifact_id")


@query("k01_shard_plan", """WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderpriority, o_orderkey, length(o_orderpriority) AS bytes, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth FROM orders),
s(o_orderpriority, o_orderkey, nth, shard_id, used, n) AS (SELECT o_orderpriority, o_orderkey, nth, 0::bigint, bytes, 1 FROM o WHERE nth = 1 UNION ALL
  SELECT o.o_orderpriority, o.o_orderkey, o.nth, s.shard_id + (s.n >= 100 OR s.used + 1 + o.bytes > 900)::int, CASE WHEN s.n >= 100 OR s.used + 1 + o.bytes > 900 THEN o.bytes ELSE s.used + 1 + o.bytes END, CASE WHEN s.n >= 100 OR s.used + 1 + o.bytes > 900 THEN 1 ELSE s.n + 1 END
  FROM s JOIN o ON o.o_orderpriority = s.o_orderpriority AND o.nth = s.nth + 1)
SELECT o_orderpriority, o_orderkey, shard_id FROM s""")
def k01_shard_plan(spark, sf):
    """Greedy size-bounded shards of each priority's orders: some are full by bytes, some by records."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderpriority", "o_orderkey", F.length("o_orderpriority").alias("bytes"))
    return report.shard_plan(o, ["o_orderpriority"], "o_orderkey", "bytes", 900, 100)


@query("s15_classpath_rows", """, d AS (SELECT module_key, group_id, artifact_id, effective_scope, min(seq) AS seq FROM occ GROUP BY ALL)
SELECT module_key, group_id, artifact_id, effective_scope, CAST(row_number() OVER (PARTITION BY module_key ORDER BY seq) - 1 AS INT) AS position FROM d""", ("occ",))
def s15_classpath_rows(spark, sf):
    rows = normalize.classpath_rows(bound(spark, sf, "occ"), ["module_key"], ["group_id", "artifact_id", "effective_scope"], ["seq"])
    return rows.select(*MODULE_KEY, "effective_scope", "position")


@query("f10_jar_pairs", _FIRST + """, c AS (SELECT *, CASE WHEN in_t THEN ts ELSE bs END AS scope, CASE WHEN CAST(bv AS INT) % 3 = 0 THEN 'war' ELSE 'jar' END AS ot FROM j WHERE in_b AND in_t AND bv <> tv)
SELECT concat(group_id, ':', artifact_id, ':', bv) AS old_coordinate, concat(group_id, ':', artifact_id, ':', tv) AS new_coordinate, bool_or(scope = 'provided') AS provided_api_risk, count(DISTINCT module_key) AS modules
FROM c WHERE ot = 'jar' AND scope IN ('compile', 'provided') GROUP BY ALL""", ("occ",))
def f10_jar_pairs(spark, sf):
    b, t = _sides(spark, sf, "occ")
    changes = diff.dependency_changes(_first(b), _first(t), MODULE_KEY)
    name = lambda v: F.concat_ws(":", "group_id", "artifact_id", v)
    kinds = {"old_type": F.when(F.col("old_version").cast("int") % 3 == 0, "war").otherwise("jar"), "new_type": F.lit("jar"), "old_coordinate": name("old_version"), "new_coordinate": name("new_version")}
    return selection.jar_pairs(changes.withColumns(kinds), ["compile", "provided"])


@query("j09_dynamic_evidence", """, c AS (SELECT node, owner, name, descriptor, node % 3 = 0 AS field_handle FROM refs WHERE ref_kind IN ('invoke', 'field'))
SELECT DISTINCT point_id, node, 'METHOD_REFERENCE' AS evidence FROM c JOIN points p ON p.kind IN ('METHOD_REMOVED', 'METHOD_DESCRIPTOR_CHANGED', 'METHOD_ACCESS_NARROWED') AND p.owner = c.owner AND p.name = c.name AND p.old_descriptor = c.descriptor
UNION SELECT DISTINCT point_id, node, 'TYPE_REFERENCE' FROM c JOIN points p ON p.kind = 'CLASS_ACCESS_NARROWED' AND p.owner = c.owner
UNION SELECT DISTINCT point_id, node, 'FIELD_REFERENCE' FROM c JOIN points p ON p.kind = 'FIELD_ACCESS_NARROWED' AND c.field_handle AND p.owner = c.owner AND p.name = c.name AND p.new_descriptor = c.descriptor""", ("points", "refs"))
def j09_dynamic_evidence(spark, sf):
    calls = bound(spark, sf, "refs").where("ref_kind IN ('invoke', 'field')").withColumn("field_handle", F.col("node") % 3 == 0)
    return impact.dynamic_evidence(calls, bound(spark, sf, "points"))


@query("a18_scope_warnings", """SELECT artifact, count(*) AS findings, count(DISTINCT excluded_type) AS excluded_types, array_to_string(list_sort(list_distinct(list(concat(source, ' -> ', excluded_type))))[1:5], ', ') AS examples
FROM (SELECT p_brand AS artifact, p_name AS source, p_type AS excluded_type FROM part) GROUP BY artifact""")
def a18_scope_warnings(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return impact.scope_warnings(p.select(F.col("p_brand").alias("artifact"), F.col("p_name").alias("source"), F.col("p_type").alias("excluded_type")))


@query("a19_comparison_counters", """SELECT p_brand, count(*) FILTER (j = 'IDENTICAL') AS java_identical, count(*) FILTER (j = 'DIFFERENT') AS java_different, count(*) FILTER (j = 'UNKNOWN') AS java_unknown, count(*) FILTER (j <> 'IDENTICAL' AND s = 'MATCHED') AS ssa_matched,
 count(*) FILTER (j <> 'IDENTICAL' AND s = 'DIFFERENT') AS ssa_different, count(*) FILTER (j <> 'IDENTICAL' AND s = 'UNKNOWN') AS ssa_unknown, count(*) FILTER (j = 'IDENTICAL') AS ssa_skipped, count(*) FILTER (j = 'IDENTICAL' OR s = 'MATCHED') AS suppressed,
 count(*) FILTER (j <> 'IDENTICAL' AND s <> 'MATCHED') AS retained, CAST(sum(ms) AS BIGINT) AS elapsed_ms
FROM (SELECT p_brand, p_size * 3 AS ms, CASE WHEN p_size % 5 = 0 THEN 'IDENTICAL' WHEN p_size % 7 = 1 THEN 'UNKNOWN' ELSE 'DIFFERENT' END AS j, CASE p_size % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'DIFFERENT' ELSE 'UNKNOWN' END AS s FROM part) GROUP BY p_brand""")
def a19_comparison_counters(spark, sf):
    size = F.col("p_size")
    java = F.when(size % 5 == 0, "IDENTICAL").when(size % 7 == 1, "UNKNOWN").otherwise("DIFFERENT")
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", java.alias("java_status"), F.when(size % 3 == 0, "MATCHED").when(size % 3 == 1, "DIFFERENT").otherwise("UNKNOWN").alias("ssa_status"), (size * 3).alias("elapsed_ms"))
    return impact.comparison_counters(rows, ["p_brand"])
