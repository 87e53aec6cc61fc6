"""Registered queries over values of method bodies and the order of checks, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataflow, impact
from .bindings import bound, bound_sql
from .catalog import ORACLE_SQL, query

_IR = ("ir_values", "ir_uses")


def _oracle(name: str, uses: tuple[str, ...], sql: str) -> None:
    ORACLE_SQL[name] = (bound_sql(*uses) + sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("g19_local_constants")
def g19_local_constants(spark, sf):
    """The string constant of every value that has one."""
    return dataflow.local_constants(bound(spark, sf, "ir_values"), bound(spark, sf, "ir_uses"), "string").select("body", "value", "status", "text")


_oracle("g19_local_constants", _IR, """, p(body, root, here, seen, circle) AS (SELECT body, value, value, [value], false FROM ir_values
  UNION ALL SELECT p.body, root, u.input, list_append(seen, u.input), list_contains(seen, u.input) FROM p JOIN ir_uses u ON u.body = p.body AND u.value = p.here WHERE NOT circle),
ends AS (SELECT p.body, p.root, circle OR v.kind IS NULL OR v.kind <> 'string' AS open, v.text FROM p LEFT JOIN ir_values v ON v.body = p.body AND v.value = p.here WHERE circle OR v.kind IS NULL OR v.kind NOT IN ('cast', 'pi', 'phi')),
r AS (SELECT body, root, NOT bool_or(open) AND count(DISTINCT text) = 1 AS good, min(text) AS text FROM ends GROUP BY body, root)
SELECT body, root AS value, CASE WHEN good THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN good THEN text END AS text FROM r""")


def _types(spark):
    """Types T0 to T7 in a chain of threes; T8 is not known, T6 is abstract."""
    types = spark.range(8).select(F.concat(F.lit("T"), "id").alias("type"), (F.col("id") != 6).alias("concrete"))
    pairs = spark.range(8).crossJoin(spark.range(8).withColumnRenamed("id", "up")).where("id % 3 = up % 3 AND id >= up")  # 64 fixed pairs
    return types, pairs.select(F.concat(F.lit("T"), "id").alias("sub"), F.concat(F.lit("T"), "up").alias("super"))


@query("g18_receiver_types")
def g18_receiver_types(spark, sf):
    """What is known of the type of every value."""
    types, assignable = _types(spark)
    found = dataflow.receiver_types(bound(spark, sf, "ir_values"), bound(spark, sf, "ir_uses"), types, assignable)
    return found.withColumn("types", F.array_join("types", ","))


# seven values a body at most: so many rounds settle all that is on no circle, and as many more what lies behind circles
def _receiver_rounds() -> str:
    step = """k{n} AS MATERIALIZED (SELECT * FROM k{m} UNION ALL SELECT c.body, c.value,
  CASE WHEN c.kind = 'phi' THEN CASE WHEN bool_or(k.fact = 'UNKNOWN') THEN 'UNKNOWN' WHEN bool_and(k.fact = 'NO_NORMAL_TARGET') THEN 'NO_NORMAL_TARGET' WHEN bool_or(k.fact = 'UPPER_BOUND') THEN 'UNKNOWN' ELSE 'EXACT' END
    WHEN c.kind = 'pi' THEN min(k.fact) WHEN c.type = 'T8' THEN 'UNKNOWN' WHEN min(k.fact) = 'NO_NORMAL_TARGET' THEN 'NO_NORMAL_TARGET' WHEN min(k.fact) <> 'EXACT' THEN 'UPPER_BOUND'
    WHEN list_contains(flatten(list(k.types)), 'T8') THEN 'UNKNOWN' WHEN len(list_filter(flatten(list(k.types)), lambda t: fits(t, c.type))) = 0 THEN 'NO_NORMAL_TARGET' ELSE 'EXACT' END AS fact,
  CASE WHEN c.kind = 'phi' THEN CASE WHEN bool_or(k.fact IN ('UNKNOWN', 'UPPER_BOUND')) OR bool_and(k.fact = 'NO_NORMAL_TARGET') THEN [] ELSE list_sort(list_distinct(flatten(list(k.types)))) END
    WHEN c.kind = 'pi' THEN flatten(list(k.types)) WHEN c.type = 'T8' OR min(k.fact) = 'NO_NORMAL_TARGET' THEN [] WHEN min(k.fact) <> 'EXACT' THEN [c.type]
    WHEN list_contains(flatten(list(k.types)), 'T8') THEN [] ELSE list_sort(list_filter(flatten(list(k.types)), lambda t: fits(t, c.type))) END AS types
  FROM comp c JOIN ir_uses u ON u.body = c.body AND u.value = c.value JOIN k{m} k ON k.body = u.body AND k.value = u.input
  WHERE NOT EXISTS (SELECT 1 FROM k{m} o WHERE o.body = c.body AND o.value = c.value) GROUP BY c.body, c.value, c.kind, c.type, c.n HAVING count(*) = c.n)"""
    fits = "(substr(t, 2)::int % 3 = substr(c.type, 2)::int % 3 AND substr(t, 2)::int >= substr(c.type, 2)::int AND t <> 'T8')"
    parts = [step.format(n=n, m=n - 1).replace("fits(t, c.type)", fits) for n in range(1, 8)]
    parts.append("""k8 AS MATERIALIZED (SELECT * FROM k7 UNION ALL SELECT body, value, 'UNKNOWN', [] FROM circ x WHERE NOT EXISTS (SELECT 1 FROM k7 o WHERE o.body = x.body AND o.value = x.value))""")
    parts += [step.format(n=n, m=n - 1).replace("fits(t, c.type)", fits) for n in range(9, 16)]
    return ",\n".join(parts)


_oracle("g18_receiver_types", _IR, """, comp AS MATERIALIZED (SELECT v.body, v.value, v.kind, v.type, (SELECT count(*) FROM ir_uses u WHERE u.body = v.body AND u.value = v.value) AS n FROM ir_values v WHERE kind IN ('cast', 'pi', 'phi')),
cl(body, a, b) AS (SELECT body, value, input FROM ir_uses UNION SELECT cl.body, cl.a, u.input FROM cl JOIN ir_uses u ON u.body = cl.body AND u.value = cl.b),
circ AS MATERIALIZED (SELECT body, a AS value FROM cl WHERE a = b),
k0 AS MATERIALIZED (SELECT body, value, CASE kind WHEN 'null' THEN 'NO_NORMAL_TARGET' WHEN 'new' THEN 'EXACT' ELSE 'UNKNOWN' END AS fact, CASE WHEN kind = 'new' THEN [type] ELSE []::varchar[] END AS types FROM ir_values WHERE kind NOT IN ('cast', 'pi', 'phi')
  UNION ALL SELECT DISTINCT u.body, u.input, 'UNKNOWN', []::varchar[] FROM ir_uses u WHERE NOT EXISTS (SELECT 1 FROM ir_values v WHERE v.body = u.body AND v.value = u.input)),
""" + _receiver_rounds() + """
SELECT k.body, k.value, k.fact AS kind, array_to_string(k.types, ',') AS types FROM k15 k JOIN ir_values v ON v.body = k.body AND v.value = k.value""")


@query("g18_pruned_sites")
def g18_pruned_sites(spark, sf):
    """Verdicts of the call sites on all values, as the pruning takes them."""
    values = bound(spark, sf, "ir_values")
    types, assignable = _types(spark)
    receivers = dataflow.receiver_types(values, bound(spark, sf, "ir_uses"), types, assignable)
    targets = types.select("type", F.lit("run()").alias("selector"), F.concat(F.lit("m"), (F.substring("type", 2, 2).cast("int") % 3).cast("string")).alias("target"), (F.col("type") == "T7").alias("abstract"))
    sites = values.select("body", "value", F.lit("run()").alias("selector"), F.concat(F.lit("m"), (F.col("value") % 3).cast("string")).alias("candidate"))
    verdicts = dataflow.dispatch_verdicts(sites, receivers, types, targets, assignable)
    rows = verdicts.select((F.col("body") % 7).alias("module"), F.col("body").alias("caller_id"), F.col("value").cast("long").alias("callee_id"), F.lit(True).alias("is_dispatch"), F.lit(2).alias("n_targets"), F.col("verdict").alias("receiver_verdict"))
    return impact.pruned_edges(rows).select("module", "caller_id", "callee_id")


@query("g23_factory_types")
def g23_factory_types(spark, sf):
    """Types that the results of calls are cast to."""
    values = bound(spark, sf, "ir_values")
    results = values.where("kind = 'param'").select(F.concat_ws(":", F.col("body").cast("string"), F.col("value").cast("string")).alias("call"), "body", "value")
    return dataflow.factory_types(results, values, bound(spark, sf, "ir_uses"), _types(spark)[0].where("concrete"))


_oracle("g23_factory_types", _IR, """, f(call, body, here, hops) AS (SELECT concat(body, ':', value), body, value, 0 FROM ir_values WHERE kind = 'param'
  UNION SELECT f.call, f.body, u.value, f.hops + 1 FROM f JOIN ir_uses u ON u.body = f.body AND u.input = f.here JOIN ir_values v ON v.body = u.body AND v.value = u.value AND v.kind IN ('phi', 'pi') WHERE f.hops < 8),
c AS (SELECT call, v.type, f.hops, v.value FROM f JOIN ir_uses u ON u.body = f.body AND u.input = f.here JOIN ir_values v ON v.body = u.body AND v.value = u.value AND v.kind = 'cast' WHERE v.type NOT IN ('T6', 'T8'))
SELECT call, type, arg_min(value, hops * 100 + value) AS "cast", min(hops) AS hops FROM c GROUP BY call, type""")


@query("g21_checks")
def g21_checks(spark, sf):
    """Outcomes of checks that depend on two earlier ones each."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    key = F.col("p_partkey")
    checks = part.select(key.alias("check_id"), (F.col("p_size") % 3 == 0).alias("degradable"), (F.col("p_size") % 2 == 0).alias("reactor"), (F.col("p_retailprice").cast("bigint") % 7 != 0).alias("passed"))
    first, second = F.floor(key / 2), F.floor(key / 3)
    needs = part.select(key.alias("check_id"), F.posexplode(F.array_distinct(F.array(first, second))).alias("ord", "depends_on")).where("depends_on < check_id")
    needs = needs.join(checks.select(F.col("check_id").alias("depends_on")), "depends_on", "left_semi")
    return dataflow.check_results(checks, needs)


ORACLE_SQL["g21_checks"] = """WITH RECURSIVE c AS MATERIALIZED (SELECT p_partkey AS id, p_size % 3 = 0 AS degradable, p_size % 2 = 0 AS reactor, cast(trunc(p_retailprice) AS BIGINT) % 7 <> 0 AS passed FROM part),
d AS MATERIALIZED (SELECT DISTINCT id, ord, dep FROM (SELECT id, 0 AS ord, id // 2 AS dep FROM c UNION ALL SELECT id, 1, id // 3 FROM c WHERE id // 3 <> id // 2) WHERE dep < id AND dep IN (SELECT id FROM c)),
t(id, dep) AS (SELECT id, dep FROM d UNION SELECT t.id, d.dep FROM t JOIN d ON d.id = t.dep),
s AS MATERIALIZED (SELECT c.*, EXISTS (SELECT 1 FROM t JOIN c x ON x.id = t.dep WHERE t.id = c.id AND NOT x.passed AND NOT x.degradable) AS skipped FROM c),
st AS MATERIALIZED (SELECT *, CASE WHEN skipped THEN 'SKIPPED' WHEN passed THEN 'PASS' WHEN degradable THEN 'WARN' ELSE 'FAIL' END AS status FROM s)
SELECT id AS check_id, status, CASE status WHEN 'PASS' THEN 'CONTINUE' WHEN 'WARN' THEN 'DEGRADE' ELSE CASE WHEN reactor THEN 'BLOCK_REACTOR' ELSE 'BLOCK_COMMAND' END END AS decision,
  coalesce((SELECT string_agg(d.dep::varchar, ',' ORDER BY d.ord) FROM d JOIN st x ON x.id = d.dep WHERE d.id = st.id AND x.status IN ('FAIL', 'SKIPPED')), '') AS blockers FROM st"""
