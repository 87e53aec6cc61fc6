"""Stand-in tables for the domain relations: the same SQL text serves Spark and the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

BINDINGS = {
    "occ": """
SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24 00:00:00' THEN 'baseline' ELSE 'target' END AS side, concat('m', l_orderkey % 40) AS module_key, p_brand AS group_id,
       concat('a', l_partkey % 50) AS artifact_id, CAST(l_linenumber AS STRING) AS requested_version, CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_linenumber % 3 AS STRING) ELSE '' END AS managed_from_version,
       CAST(1 + (l_linenumber + l_suppkey) % 4 AS STRING) AS effective_version, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(1 + l_linenumber % 4 AS STRING) END AS selected_version,
       CASE l_returnflag WHEN 'A' THEN 'compile' WHEN 'R' THEN 'runtime' ELSE 'provided' END AS effective_scope, l_linestatus = 'O' AS selected,
       CASE l_suppkey % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'cycle' ELSE '' END AS omitted_reason, 1 + l_partkey % 3 AS depth,
       concat('p', l_suppkey % 4, '>', p_size % 3) AS path, row_number() OVER (PARTITION BY l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "class_def": """
SELECT DISTINCT concat('c', l_partkey % 400) AS binary_name, CASE s_nationkey % 5 WHEN 0 THEN 'JDK' WHEN 1 THEN 'PROJECT' WHEN 2 THEN 'REACTOR_DEPENDENCY' WHEN 3 THEN 'DEPENDENCY' ELSE 'SYNTHETIC' END AS origin,
       concat('s', l_suppkey) AS source_key, concat('d', (l_partkey + l_suppkey) % 3) AS digest, concat('e', l_partkey % 7) AS entry_name, l_suppkey * 1000 + l_partkey % 7 AS scan_ord
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    # what a side has, and how, follows sums over its rows, so that the sides differ at every size
    "class_info": """
SELECT side, owner, CASE s % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PACKAGE_PRIVATE' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC' END AS access FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24 00:00:00' THEN 'baseline' ELSE 'target' END AS side, concat('o', l_partkey % 600) AS owner, CAST(sum(l_suppkey + l_linenumber) AS BIGINT) AS s FROM {lineitem} GROUP BY 1, 2) x
WHERE s % 13 <> 0""",
    "method_info": """
SELECT side, owner, name, descriptor, CASE s % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PACKAGE_PRIVATE' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC' END AS access, CASE WHEN s % 9 = 0 THEN NULL ELSE concat('h', s % 3) END AS body_hash FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24 00:00:00' THEN 'baseline' ELSE 'target' END AS side, concat('o', l_partkey % 100) AS owner, concat('n', l_suppkey % 30) AS name, concat('(', l_linenumber % 2, ')') AS descriptor, CAST(sum(l_orderkey + l_linenumber) AS BIGINT) AS s
  FROM {lineitem} GROUP BY 1, 2, 3, 4) x
WHERE s % 11 <> 0""",
    "field_info": """
SELECT side, owner, name, concat('T', s % 3) AS descriptor, CASE s % 4 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'PACKAGE_PRIVATE' WHEN 2 THEN 'PROTECTED' ELSE 'PUBLIC' END AS access FROM (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24 00:00:00' THEN 'baseline' ELSE 'target' END AS side, concat('o', l_partkey % 100) AS owner, concat('f', l_suppkey % 40) AS name, CAST(sum(l_orderkey + l_suppkey) AS BIGINT) AS s
  FROM {lineitem} GROUP BY 1, 2, 3) x
WHERE s % 11 <> 0""",
    "registration": """
SELECT DISTINCT CASE WHEN l_shipdate < TIMESTAMP '1998-05-24 00:00:00' THEN 'baseline' ELSE 'target' END AS side, concat('svc', l_suppkey % 20) AS service, concat('o', l_partkey % 600) AS provider FROM {lineitem}""",
    "edge": """
SELECT DISTINCT o_custkey % 5 AS module, o_custkey AS src, (1 + (o_orderkey * 31 + 7) % n) * 5 % n + o_custkey % 5 AS dst FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) c""",
    "edge1": """
SELECT DISTINCT o_custkey AS src, 1 + (o_orderkey * 31 + 7) % n AS dst FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) c""",
    # a call graph whose edges lead from greater to smaller nodes, but for a few that close cycles
    "flow": """
SELECT module, CASE WHEN back THEN least(a, b) ELSE greatest(a, b) END AS src, CASE WHEN back THEN greatest(a, b) ELSE least(a, b) END AS dst, count(*) AS n_sites FROM (
  SELECT o_custkey % 5 AS module, o_custkey AS a, (1 + (o_orderkey * 31 + 7) % n) * 5 % n + o_custkey % 5 AS b, o_orderkey % 997 = 0 AS back FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) c) x
GROUP BY ALL""",
    "flow_node": """
SELECT module, node, concat('m', node % 211) AS method, CASE node % 4 WHEN 0 THEN 'DEPENDENCY' ELSE 'PROJECT' END AS origin, node % 10 = 3 AS is_entrypoint, node % 29 = 11 AS synthetic FROM (
  SELECT o_custkey % 5 AS module, o_custkey AS node FROM {orders} UNION SELECT o_custkey % 5, (1 + (o_orderkey * 31 + 7) % n) * 5 % n + o_custkey % 5 FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) c) x""",
    "sites": """
SELECT o_custkey % 5 AS module, o_custkey % 97 AS caller_id, o_orderkey % 53 AS callee_id, o_orderstatus <> 'P' AS is_dispatch, CAST(1 + o_orderkey % 6 AS INT) AS n_targets,
       CASE WHEN o_orderkey % 4 < 3 THEN 'EXCLUDES' WHEN o_orderkey % 8 = 3 THEN 'REACHES' WHEN o_orderkey % 16 = 7 THEN NULL ELSE 'UNKNOWN' END AS receiver_verdict FROM {orders}""",
    # bodies of a few values each: constants, allocations, casts and phis, some of them in circles
    "ir_values": """
SELECT body, value, CASE k WHEN 0 THEN 'string' WHEN 1 THEN 'new' WHEN 2 THEN 'cast' WHEN 3 THEN 'pi' WHEN 4 THEN 'phi' WHEN 5 THEN 'phi' WHEN 6 THEN 'string' WHEN 7 THEN 'null' ELSE 'param' END AS kind, concat('T', t) AS type, concat('c', c) AS text
FROM (SELECT l_orderkey AS body, l_linenumber AS value, max((l_partkey + l_suppkey) % 9) AS k, max(l_partkey % 9) AS t, max(l_suppkey % 2) AS c FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x""",
    "ir_uses": """
SELECT body, value, o AS ord, CASE o WHEN 0 THEN 1 + a ELSE 1 + b END AS input
FROM (SELECT l_orderkey AS body, l_linenumber AS value, max((l_partkey + l_suppkey) % 9) AS k, max(l_suppkey % 6) AS a, max(l_partkey % 6) AS b FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) y
WHERE k BETWEEN 4 AND 5 OR (k BETWEEN 2 AND 3 AND o = 0)""",
    "points": """
SELECT DISTINCT p_partkey AS point_id, concat('o', p_partkey % 100) AS owner, concat('n', p_size % 30) AS name, CASE p_partkey % 10 WHEN 0 THEN 'METHOD_REMOVED' WHEN 1 THEN 'METHOD_DESCRIPTOR_CHANGED' WHEN 2 THEN 'METHOD_ACCESS_NARROWED'
         WHEN 3 THEN 'FIELD_REMOVED' WHEN 4 THEN 'FIELD_DESCRIPTOR_CHANGED' WHEN 5 THEN 'CLASS_REMOVED' WHEN 6 THEN 'CLASS_ACCESS_NARROWED' WHEN 7 THEN 'METHOD_BODY_CHANGED' WHEN 8 THEN 'METHOD_ADDED' ELSE 'FIELD_ACCESS_NARROWED' END AS kind,
       concat('(', p_size % 2, ')') AS old_descriptor, concat('(', p_size % 3, ')') AS new_descriptor FROM {part}""",
    "refs": """
SELECT DISTINCT l_orderkey % 500 AS node, CASE l_linenumber % 4 WHEN 0 THEN 'invoke' WHEN 1 THEN 'field' WHEN 2 THEN 'type' ELSE 'declaration' END AS ref_kind, concat('o', l_partkey % 100) AS owner, concat('n', l_suppkey % 30) AS name,
       concat('(', l_linenumber % 3, ')') AS descriptor FROM {lineitem}""",
    "access_facts": """
SELECT c_custkey AS request_id, concat('p', c_nationkey % 4, '/C', c_custkey % 3) AS caller, concat('p', c_custkey % 4, '/C', c_nationkey % 3) AS declaring, CASE c_custkey % 7 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'PRIVATE' WHEN 2 THEN 'PACKAGE_PRIVATE' ELSE 'PROTECTED' END AS access,
       c_custkey % 3 <> 0 AS is_instance, CASE c_nationkey % 5 WHEN 0 THEN 'THIS' WHEN 1 THEN 'SUPER' WHEN 2 THEN 'POINT' WHEN 3 THEN 'CONE' ELSE 'UNKNOWN' END AS receiver_kind, c_custkey % 4 <> 0 AS caller_sub, c_custkey % 6 <> 0 AS owner_related,
       c_custkey % 2 = 0 AS receiver_assignable FROM {customer}""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = BINDINGS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def bound_sql(*names: str) -> str:
    """The bindings as common table expressions for the oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n].format(**{t: t for t in TABLES})})" for n in names)
