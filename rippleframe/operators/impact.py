"""Evidence, access checks, dispositions and impact totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ADDED_KINDS, COVERAGE_PRECEDENCE, package_of, ranked
from .places import pairs_by_place

#: Which reference kinds are evidence of which change kinds.
EVIDENCE = {
    "invoke": ["METHOD_REMOVED", "METHOD_DESCRIPTOR_CHANGED", "METHOD_ACCESS_NARROWED"],
    "field": ["FIELD_REMOVED", "FIELD_DESCRIPTOR_CHANGED", "FIELD_ACCESS_NARROWED"],
    "type": ["CLASS_REMOVED", "CLASS_ACCESS_NARROWED"],
    "declaration": ["METHOD_BODY_CHANGED"],
}


def graph_relevant(points: DataFrame) -> DataFrame:
    """F12."""
    return points.where(~F.col("kind").isin(*ADDED_KINDS))


def evidence(refs: DataFrame, points: DataFrame) -> DataFrame:
    """References (node, ref_kind, owner, name, descriptor) by change points, one equi-join for each shape.

    The descriptor that a point is found by is the old one of removals and descriptor changes, the new one of body
    changes and narrowed methods, and either of fields.
    """
    old = ["METHOD_REMOVED", "METHOD_DESCRIPTOR_CHANGED"]
    key = F.when(F.col("kind").isin(*old), F.array("old_descriptor")).when(F.col("kind").startswith("FIELD"), F.array_distinct(F.array_compact(F.array("old_descriptor", "new_descriptor")))).otherwise(F.array("new_descriptor"))
    members = points.where(~F.col("kind").startswith("CLASS")).withColumn("descriptor", F.explode(key))
    parts = []
    for ref_kind, kinds in EVIDENCE.items():
        r = refs.where(F.col("ref_kind") == ref_kind)
        on = ["owner"] if ref_kind == "type" else ["owner", "name", "descriptor"]
        p = (points if ref_kind == "type" else members).where(F.col("kind").isin(*kinds)).select("point_id", "kind", *on)
        parts.append(pairs_by_place(p, r.select("node", "ref_kind", *on), on).select("point_id", "kind", "ref_kind", "node"))
    return reduce(DataFrame.union, parts)  # each part has its own kinds of references


def access_decision(caller: Column, declaring: Column, access: Column, instance: Column, receiver_kind: Column, caller_sub: Column, owner_related: Column, receiver_assignable: Column, caller_loader: Column | None = None, declaring_loader: Column | None = None) -> Column:
    """``decision:reason`` of one access; the hierarchy's answers come as columns, and one that is null is no.

    A runtime package is a loader's: where loaders are given, they must be the same.
    """
    same_package = package_of(caller) == package_of(declaring)
    if caller_loader is not None:
        same_package &= caller_loader.eqNullSafe(declaring_loader)
    caller_sub, owner_related, receiver_assignable = (F.coalesce(c, F.lit(False)) for c in (caller_sub, owner_related, receiver_assignable))
    receiver = (
        F.when(receiver_kind == "THIS", "ACCESSIBLE:PROTECTED_THIS_RECEIVER")
        .when(receiver_kind == "SUPER", "ACCESSIBLE:PROTECTED_SUPER_RECEIVER")
        .when(receiver_kind.isin("POINT", "CONE") & receiver_assignable, "ACCESSIBLE:PROTECTED_RECEIVER_ASSIGNABLE")
        .when(receiver_kind == "POINT", "INACCESSIBLE:PROTECTED_RECEIVER_NOT_ASSIGNABLE")
        .otherwise("POTENTIALLY_INACCESSIBLE:PROTECTED_RECEIVER_UNKNOWN")
    )
    return (
        F.when(access == "PUBLIC", "ACCESSIBLE:PUBLIC_ACCESS")
        .when((access == "PRIVATE") & (caller == declaring), "ACCESSIBLE:DECLARING_CLASS")
        .when(access == "PRIVATE", "INACCESSIBLE:PRIVATE_MEMBER")
        .when(same_package, "ACCESSIBLE:SAME_RUNTIME_PACKAGE")
        .when(access == "PACKAGE_PRIVATE", "INACCESSIBLE:DIFFERENT_RUNTIME_PACKAGE")
        .when(~caller_sub, "INACCESSIBLE:PROTECTED_CALLER_NOT_SUBCLASS")
        .when(~owner_related, "INACCESSIBLE:PROTECTED_SYMBOLIC_OWNER")
        .when(~instance, "ACCESSIBLE:PROTECTED_STATIC_SUBCLASS")
        .otherwise(receiver)
    )


def pruned_edges(sites: DataFrame) -> DataFrame:
    """edges of which every call site's receiver excludes the callee.

    Fixed and single-target sites keep their edge, and so does anything unknown: a null counts as unknown.
    """
    excludes = F.col("is_dispatch") & (F.col("n_targets") > 1) & (F.col("receiver_verdict") == "EXCLUDES")
    every = F.bool_and(F.coalesce(excludes, F.lit(False))).alias("_gone")
    return sites.groupBy("module", "caller_id", "callee_id").agg(every).where("_gone").drop("_gone")


def representative_paths(paths: DataFrame) -> DataFrame:
    """Of each (point, root) the shortest path, then the smallest sequence of nodes, then the smallest evidence."""
    return paths.groupBy("point_id", "root").agg(F.min(F.struct(F.size("nodes").alias("length"), F.col("nodes"), F.col("evidence_key"))).alias("best")).select("point_id", "root", "best.*")


def disposition(kind: Column, analysed: Column, shadowed: Column, path: Column, seeds: Column, unreachable: Column, accessible_only: Column) -> Column:
    """G14."""
    return (
        F.when(~analysed, "CHANGE_KIND_NOT_ANALYZED").when(shadowed, "SHADOWED_BY_DUPLICATE").when(path, "IMPACT_REPORTED").when(seeds, "NO_PROJECT_PATH")
        .when(unreachable, "UNREACHABLE_STRUCTURAL_REFERENCE").when(kind.endswith("_ACCESS_NARROWED") & accessible_only, "ACCESS_REMAINS_VALID")
        .when(kind == "METHOD_BODY_CHANGED", "TARGET_NOT_FOUND").otherwise("DECLARED_REFERENCE_NOT_FOUND")
    )


def impact_totals(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """By module, distinct paths, root methods, PROJECT methods on any path, and changed members.

    A path is told by its nodes.  ``nodes`` (module, node, method, origin) names the methods.
    """
    on = paths.select("module", F.explode("nodes").alias("node")).distinct().join(nodes.where("origin = 'PROJECT'").select("module", "node", "method"), ["module", "node"])
    methods = on.groupBy("module").agg(F.count_distinct("method").alias("_methods"))
    totals = paths.groupBy("module").agg(F.count_distinct("nodes").alias("unique_paths"), F.count_distinct("root").alias("root_methods"), F.count_distinct("point_id").alias("changed_members"))
    return totals.join(methods, "module", "left").select("module", "unique_paths", "root_methods", F.coalesce("_methods", F.lit(0)).alias("affected_methods"), "changed_members")


def member_metrics(points: DataFrame, paths: DataFrame) -> DataFrame:
    """Impact and structural counts of every point, zeros kept."""
    n = paths.groupBy("point_id").agg(F.count_if(F.col("path_kind") == "impact").alias("impact"), F.count_if(F.col("path_kind") == "structural").alias("structural"))
    return points.select("point_id").join(n, "point_id", "left").na.fill(0, ["impact", "structural"])


def coverage_reason(reasons: DataFrame, by: list[str]) -> DataFrame:
    """The reason of highest precedence, NONE without any."""
    return reasons.groupBy(*by).agg(F.coalesce(F.min_by("reason", F.when(F.col("reason").isNotNull(), ranked(F.col("reason"), COVERAGE_PRECEDENCE, 99))), F.lit("NONE")).alias("reason"))


def overall_status(modules: DataFrame, by: list[str]) -> DataFrame:
    """A21."""
    failed, done = F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status").isin("COMPLETED", "INCONCLUSIVE"))
    return modules.groupBy(*by).agg(F.when((failed > 0) & (done > 0), "PARTIAL_SUCCESS").when(failed > 0, "FAILED").when(F.bool_or(F.col("status") == "INCONCLUSIVE"), "INCONCLUSIVE").otherwise("SUCCESS").alias("status"))


def diff_terminal_state(modules: DataFrame, by: list[str]) -> DataFrame:
    """A22."""
    return modules.groupBy(*by).agg(F.when(F.count_if(F.col("status") == "COMPARABLE") == 0, "FAILED").when(F.bool_or("has_issue"), "COMPLETED_WITH_ISSUES").otherwise("SUCCESS").alias("state"))


def sample_summary(samples: DataFrame, by: list[str], measure: str, first: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Minimum, median and maximum; the counters in ``first`` come from the first row by ``order``."""
    others = [F.min_by(c, order).alias(c) for c in first]
    return samples.groupBy(*by).agg(F.min(measure).alias("min_value"), F.median(measure).alias("median_value"), F.max(measure).alias("max_value"), F.count(F.lit(1)).alias("samples"), *others)


def ratio(numerator: Column, base: Column) -> Column:
    """Null (unavailable) where the base is zero."""
    return F.try_divide(numerator, base)


def constant_evidence(literals: DataFrame, points: DataFrame, registrations: DataFrame) -> DataFrame:
    """Constants of class lookups that name a removed class, of service loads that name a baseline service.

    literals (node, origin, call, literal); callers of the JDK are passed over.
    """
    own = literals.where("origin <> 'JDK'")
    removed = points.where("kind = 'CLASS_REMOVED'").select("point_id", F.replace("owner", F.lit("/"), F.lit(".")).alias("literal"))
    of = lambda things, facts, name: pairs_by_place(things, facts.select("node", "literal"), ["literal"]).select("point_id", "node", F.lit(name).alias("mechanism"))
    gone = points.where("kind = 'SERVICE_PROVIDER_REGISTRATION_REMOVED'").select("point_id", F.col("owner").alias("literal"))
    loads = own.where("call = 'load'").join(registrations.select(F.col("service").alias("literal")).distinct(), "literal", "left_semi")
    return of(removed, own.where("call = 'forName'"), "class_lookup").union(of(gone, loads, "service_load"))


def dynamic_evidence(calls: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, node, evidence) of dynamic calls (node, owner, name, descriptor, field_handle) by change point.

    Removed, re-described and narrowed methods are met by owner, name and old descriptor; narrowed classes by owner;
    narrowed fields by a field handle's owner, name and new descriptor.  Three equi-joins instead of one condition.
    """
    of = lambda *kinds: points.where(F.col("kind").isin(*kinds))
    methods = of("METHOD_REMOVED", "METHOD_DESCRIPTOR_CHANGED", "METHOD_ACCESS_NARROWED").select("point_id", "owner", "name", F.col("old_descriptor").alias("descriptor"))
    fields = of("FIELD_ACCESS_NARROWED").select("point_id", "owner", "name", F.col("new_descriptor").alias("descriptor"))
    parts = [
        (methods, calls, ["owner", "name", "descriptor"], "METHOD_REFERENCE"),
        (of("CLASS_ACCESS_NARROWED").select("point_id", "owner"), calls, ["owner"], "TYPE_REFERENCE"),
        (fields, calls.where("field_handle"), ["owner", "name", "descriptor"], "FIELD_REFERENCE"),
    ]
    return reduce(DataFrame.union, (pairs_by_place(p, c.select("node", *on), on).select("point_id", "node", F.lit(kind).alias("evidence")) for p, c, on, kind in parts))


def structural_evidence(references: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to removed or narrowed classes, bound to the member's node where it is a method, else to its class's.

    The nodes of a changed class are found once, whatever the number of points on it.
    """
    places = points.where("kind IN ('CLASS_REMOVED', 'CLASS_ACCESS_NARROWED')").select("point_id", F.col("owner").alias("changed_class"))
    hit = references.join(places.select("changed_class").distinct(), "changed_class", "left_semi")
    of_class = nodes.select("node", F.col("owner").alias("referencing_class"))
    of_member = nodes.select("node", F.col("owner").alias("referencing_class"), F.concat("name", "descriptor").alias("member"))
    method = hit.where(F.col("member").contains("(")).select("referencing_class", "member", "changed_class").distinct().join(of_member.distinct(), ["referencing_class", "member"])
    whole = hit.where(~F.col("member").contains("(")).select("referencing_class", "changed_class").distinct().join(of_class.distinct(), "referencing_class")
    bound = method.select("changed_class", "node").distinct().union(whole.select("changed_class", "node").distinct())
    return pairs_by_place(places, bound, ["changed_class"]).select("point_id", "node")


def affected(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """By module, distinct PROJECT methods and classes on any path."""
    on = paths.select("module", F.explode("nodes").alias("node")).distinct().join(nodes.where("origin = 'PROJECT'"), ["module", "node"])
    return on.groupBy("module").agg(F.count_distinct("owner", "name", "descriptor").alias("methods"), F.count_distinct("owner").alias("classes"))


def scope_warnings(findings: DataFrame, examples: int = 5) -> DataFrame:
    """By artifact, findings, distinct excluded types and the first few examples."""
    pairs = findings.select("artifact", F.concat_ws(" -> ", "source", "excluded_type").alias("_example")).distinct()
    first = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("artifact").orderBy("_example"))).where(F.col("_rn") <= examples)
    listed = first.groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_list("_example")), ", ").alias("examples"))
    return findings.groupBy("artifact").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("excluded_type").alias("excluded_types")).join(listed, "artifact")


def comparison_counters(comparisons: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes of body comparisons and the time they took.

    Identical texts are never compared further: their second comparison is skipped.  Unknown outcomes are kept.
    """
    java, ssa = F.col("java_status"), F.col("ssa_status")
    identical = java == "IDENTICAL"
    matched = ~identical & (ssa == "MATCHED")
    n = lambda condition, name: F.count_if(condition).alias(name)
    return comparisons.groupBy(*by).agg(
        n(identical, "java_identical"), n(java == "DIFFERENT", "java_different"), n(java == "UNKNOWN", "java_unknown"), n(matched, "ssa_matched"), n(~identical & (ssa == "DIFFERENT"), "ssa_different"), n(~identical & (ssa == "UNKNOWN"), "ssa_unknown"),
        n(identical, "ssa_skipped"), n(identical | matched, "suppressed"), n(~(identical | matched), "retained"), F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("elapsed_ms"),
    )
