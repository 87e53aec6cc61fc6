"""Registered queries over the report projections, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.places import pairs_by_place
from . import projections
from .bindings import bound
from .catalog import query

_TREE = """, r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY module_key, seq) - 1 AS row_id, dense_rank() OVER (ORDER BY module_key) - 1 AS module_id, dense_rank() OVER (ORDER BY concat(group_id, ':', artifact_id)) - 1 AS dependency_id, concat(group_id, ':', artifact_id) AS dependency, *
  FROM occ WHERE side = 'target'),
li AS (SELECT 0 AS list, dependency_id AS key, '' AS scope, row_id FROM r UNION ALL SELECT 1, NULL, effective_scope, row_id FROM r),
isl AS (SELECT *, row_id - row_number() OVER (PARTITION BY list, key, scope ORDER BY row_id) AS isle FROM li),
rg AS MATERIALIZED (SELECT row_number() OVER (ORDER BY list, key, scope, min(row_id)) - 1 AS range_id, list, key, scope, min(row_id) AS start, count(*) AS n FROM isl GROUP BY list, key, scope, isle),
v AS (SELECT module_id, dependency_id, unnest([requested_version, selected_version]) AS version FROM r),
vs AS (SELECT module_id, dependency_id, count(DISTINCT version) FILTER (trim(version) <> '') AS versions FROM v GROUP BY ALL),
ct AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r.module_id, r.dependency_id) - 1 AS catalog_id, r.module_id, r.dependency_id, count(DISTINCT selected_version) FILTER (selected AND trim(selected_version) <> '') AS resolved, any_value(versions) AS versions FROM r JOIN vs USING (module_id, dependency_id) GROUP BY r.module_id, r.dependency_id),
dp AS MATERIALIZED (SELECT dependency_id, dependency, count(DISTINCT selected_version) FILTER (selected AND trim(selected_version) <> '') AS resolved FROM r GROUP BY ALL)
"""


def _tree(spark, sf):
    rows = bound(spark, sf, "occ").where("side = 'target'")
    return projections.tree_projection(rows.withColumns({"dependency": F.concat_ws(":", "group_id", "artifact_id"), "scope": F.col("effective_scope")}))


@query("k02_dependency_rows", _TREE + "SELECT row_id, dependency_id, module_id, effective_scope AS scope, path AS chain, requested_version AS original, selected_version AS resolved FROM r", ("occ",))
def k02_dependency_rows(spark, sf):
    """Numbered occurrences of the target trees."""
    return _tree(spark, sf)["rows"].select("row_id", "dependency_id", "module_id", "scope", "chain", "original", "resolved")


@query("k02_dependency_ranges", _TREE + "SELECT * FROM rg", ("occ",))
def k02_dependency_ranges(spark, sf):
    """Posting lists of dependencies and scopes as numbered ranges of rows."""
    return _tree(spark, sf)["ranges"]


@query("k02_module_catalog", _TREE + "SELECT catalog_id, module_id, dependency_id, resolved, versions FROM ct", ("occ",))
def k02_module_catalog(spark, sf):
    return _tree(spark, sf)["catalog"]


@query("k02_dependency_descriptors", _TREE + """, a AS (SELECT dependency_id, count(DISTINCT version) FILTER (trim(version) <> '') AS versions FROM v GROUP BY ALL)
SELECT dp.*, versions, (SELECT min(range_id) FROM rg WHERE list = 0 AND key = dp.dependency_id) AS first_range, (SELECT count(*) FROM rg WHERE list = 0 AND key = dp.dependency_id) AS n_ranges FROM dp JOIN a USING (dependency_id)""", ("occ",))
def k02_dependency_descriptors(spark, sf):
    return _tree(spark, sf)["dependencies"]


@query("k02_module_descriptors", _TREE + """SELECT module_id, module_key, min(row_id) AS first_row, count(*) AS n_rows, (SELECT min(catalog_id) FROM ct WHERE ct.module_id = r.module_id) AS first_dependency, (SELECT count(*) FROM ct WHERE ct.module_id = r.module_id) AS n_dependencies,
  count(DISTINCT dependency_id) FILTER (selected AND dependency_id IN (SELECT dependency_id FROM dp WHERE resolved > 1)) AS multi_version FROM r GROUP BY module_id, module_key""", ("occ",))
def k02_module_descriptors(spark, sf):
    return _tree(spark, sf)["modules"]


@query("q02_posting_rows", _TREE + "SELECT row_id, module_id, chain FROM (SELECT row_id, module_id, path AS chain FROM r WHERE dependency = 'Brand#12:a1' AND effective_scope = 'compile')", ("occ",))
def q02_posting_rows(spark, sf):
    """Rows of a dependency in a scope by intersecting two posting lists."""
    return projections.rows_of(_tree(spark, sf), "Brand#12:a1", "compile").select("row_id", "module_id", "chain")


_AFFECTED = """, j AS MATERIALIZED (SELECT DISTINCT CASE WHEN r.node % 3 = 0 THEN 'structural' ELSE 'impact' END AS path_kind, concat(p.owner, '>', r.node % 23) AS path_key, concat('pt', p.point_id) AS member_key, p.point_id, p.owner, r.node % 23 AS spot FROM points p JOIN refs r USING (owner, name)),
mem AS MATERIALIZED (SELECT row_number() OVER (ORDER BY concat('pt', point_id)) - 1 AS member_id, concat('pt', point_id) AS member_key, kind, owner, name, point_id, concat('g', point_id % 4, ':a') AS source, concat('dep', point_id % 13) AS dependency_key FROM points),
pth AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path_kind = 'structural', path_key) - 1 AS path_id, path_kind, path_key, owner, spot FROM (SELECT DISTINCT path_kind, path_key, owner, spot FROM j)),
rws AS MATERIALIZED (SELECT row_number() OVER (ORDER BY path_id, member_id) - 1 AS row_id, path_id, member_id, source FROM j JOIN pth USING (path_kind, path_key) JOIN mem USING (member_key)),
src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source, min(row_id)) - 1 AS range_id, source, min(row_id) AS start, count(*) AS n FROM (SELECT source, row_id, row_id - row_number() OVER (PARTITION BY source ORDER BY row_id) AS isle FROM rws) GROUP BY source, isle),
mth AS MATERIALIZED (SELECT row_number() OVER (ORDER BY key) - 1 AS method_id, key FROM (SELECT DISTINCT unnest([concat('k', spot % 11), concat('k', spot % 5), concat('k', spot)]) AS key FROM pth))
"""


def _affected(spark, sf):
    points = bound(spark, sf, "points")
    at = F.col("node") % 23
    kind, key = F.when(F.col("node") % 3 == 0, "structural").otherwise("impact").alias("path_kind"), F.concat_ws(">", "owner", at.cast("string")).alias("path_key")
    refs = bound(spark, sf, "refs").select("owner", "name", "node")
    member = F.concat(F.lit("pt"), "point_id").alias("member_key")
    leads = pairs_by_place(points.select(member, "owner", "name"), refs.select("owner", "name", kind, key), ["owner", "name"]).select("path_kind", "path_key", "member_key")
    node = lambda n: F.struct(F.concat(F.lit("k"), n).alias("key"), F.concat(F.lit("M"), n).alias("label"), (n % 2 == 0).alias("project"))
    paths = refs.join(points.select("owner", "name").distinct(), ["owner", "name"], "left_semi").select(
        kind, key,
        F.when(at % 2 == 0, "DIRECT").otherwise("TRANSITIVE").alias("classification"), F.when(at % 7 == 0, "STRONGLY_CONNECTED_COMPONENT").otherwise("METHOD").alias("root_kind"),
        F.array(node(at % 11), node(at % 5), node(at)).alias("nodes"), F.array(F.concat(F.lit("M"), at % 11)).alias("affected_methods"), F.concat_ws(" ", "owner", at.cast("string")).alias("search_text"),
        F.lit("").alias("application_member"), F.lit("").alias("relation"), F.lit("").alias("changed_class"),
    ).distinct()
    new = F.col("point_id") % 13
    members = points.select(
        member, "kind", F.concat_ws("#", "owner", "name").alias("signature"), F.concat(F.lit("dep"), new).alias("dependency_key"), F.concat(F.lit("old"), new).alias("old_artifact"), F.concat(F.lit("new"), new).alias("new_artifact"),
        F.lit("compile").alias("scope"), F.concat(F.lit("g"), F.col("point_id") % 4, F.lit(":a")).alias("source"), F.when(F.col("point_id") % 3 == 0, "AVAILABLE").when(F.col("point_id") % 3 == 1, "IDENTICAL").alias("status"), F.concat(F.lit("@@ "), "point_id").alias("diff"),
    )
    return projections.affected_path_projection(paths, members, leads)


@query("k04_rows", _AFFECTED + "SELECT row_id, path_id, member_id FROM rws", ("points", "refs"))
def k04_rows(spark, sf):
    """Numbered pairs of paths and changed members."""
    return _affected(spark, sf)["rows"]


@query("k04_source_index", _AFFECTED + "SELECT range_id, start, n FROM src", ("points", "refs"))
def k04_source_index(spark, sf):
    return _affected(spark, sf)["source-index"]


@query("k04_sources", _AFFECTED + "SELECT source, min(range_id) AS first_range, count(*) AS n_ranges FROM src GROUP BY source", ("points", "refs"))
def k04_sources(spark, sf):
    return _affected(spark, sf)["sources"]


@query("k04_members", _AFFECTED + """, isl AS (SELECT member_id, min(row_id) AS start, count(*) AS n FROM (SELECT member_id, row_id, row_id - row_number() OVER (PARTITION BY member_id ORDER BY row_id) AS isle FROM rws) GROUP BY member_id, isle),
rr AS (SELECT member_id, string_agg(concat(start, '+', n), ' ' ORDER BY start) AS row_ranges FROM isl GROUP BY member_id),
df AS (SELECT member_id, row_number() OVER (ORDER BY member_id) - 1 AS diff_id FROM mem WHERE point_id % 3 = 0),
dd AS (SELECT dependency_key, row_number() OVER (ORDER BY dependency_key) - 1 AS dependency_id FROM (SELECT DISTINCT dependency_key FROM mem))
SELECT m.member_id, dd.dependency_id, kind, concat(owner, '#', name) AS signature, CASE point_id % 3 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'IDENTICAL' ELSE 'UNAVAILABLE' END AS status, diff_id, coalesce(row_ranges, '') AS row_ranges
FROM mem m JOIN dd USING (dependency_key) LEFT JOIN df USING (member_id) LEFT JOIN rr USING (member_id)""", ("points", "refs"))
def k04_members(spark, sf):
    """Changed members with the ranges of their rows."""
    ranges = F.array_join(F.transform("row_ranges", lambda x: F.concat_ws("+", x["start"].cast("string"), x["n"].cast("string"))), " ")
    return _affected(spark, sf)["members"].withColumn("row_ranges", ranges)


@query("k04_paths", _AFFECTED + """SELECT path_id, path_kind AS type, CASE WHEN spot % 2 = 0 THEN 'DIRECT' ELSE 'TRANSITIVE' END AS classification, spot % 7 = 0 AS cycle, concat(x.method_id, '>', y.method_id, '>', z.method_id) AS method_ids,
  (SELECT min(row_id) FROM rws WHERE rws.path_id = pth.path_id) AS row_start, (SELECT count(*) FROM rws WHERE rws.path_id = pth.path_id) AS row_count
FROM pth JOIN mth x ON x.key = concat('k', spot % 11) JOIN mth y ON y.key = concat('k', spot % 5) JOIN mth z ON z.key = concat('k', spot)""", ("points", "refs"))
def k04_paths(spark, sf):
    """Path records with their methods, beside the rows that the index gives them."""
    found = _affected(spark, sf)
    ids = F.array_join(F.transform("method_ids", lambda x: x.cast("string")), ">").alias("method_ids")
    return found["paths"].select("path_id", "type", "classification", "cycle", ids).join(found["index"].select("path_id", "row_start", "row_count"), "path_id")
