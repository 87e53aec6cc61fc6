"""From evidence to seeds, and from structural references to their representative paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import class_facts, classed

#: Kinds whose evidence is a seed as it is, and kinds whose evidence depends on an access check.
DIRECT_KINDS = ["METHOD_REMOVED", "METHOD_DESCRIPTOR_CHANGED", "METHOD_BODY_CHANGED", "FIELD_REMOVED", "FIELD_DESCRIPTOR_CHANGED", "CLASS_REMOVED", "SERVICE_PROVIDER_REGISTRATION_REMOVED"]
CHECKED_KINDS = ["METHOD_ACCESS_NARROWED", "FIELD_ACCESS_NARROWED", "CLASS_ACCESS_NARROWED"]


def resolve_seeds(evidence: DataFrame) -> DataFrame:
    """Method-anchored evidence (point_id, kind, node, evidence_key, declares, check) with its ``outcome``.

    Of removals, new descriptors and bodies every row is a SEED.  A narrowed access is one unless it stays ACCESSIBLE,
    which is an OBSERVATION.  A narrowed method first needs its target resolved: ``declares`` tells whether the target's
    declaration is the changed member; if it is another, the row goes, and what is not resolved (``declares`` of a
    method, or ``check``) is a LIMITATION.  Rows without a node anchor no path and go.
    """
    checked = F.col("kind").isin(*CHECKED_KINDS)
    unresolved = ((F.col("kind") == "METHOD_ACCESS_NARROWED") & F.col("declares").isNull()) | F.col("check").isNull()
    outcome = (
        F.when(F.col("kind").isin(*DIRECT_KINDS), "SEED")
        .when(checked & (F.col("kind") == "METHOD_ACCESS_NARROWED") & ~F.col("declares"), F.lit(None))
        .when(checked & unresolved, "LIMITATION")
        .when(checked & (F.col("check") == "ACCESSIBLE"), "OBSERVATION")
        .when(checked, "SEED")
    )
    return evidence.where("node IS NOT NULL").withColumn("outcome", outcome).where("outcome IS NOT NULL")


def unbound_seeds(seeds: DataFrame, bindings: DataFrame) -> DataFrame:
    """The seeds (point_id, node, evidence_key) that no binding has; there must be none."""
    return seeds.join(bindings.select("point_id", "node", "evidence_key").distinct(), ["point_id", "node", "evidence_key"], "left_anti")


def unbound_at_places(points: DataFrame, facts: DataFrame, bindings: DataFrame, on: list[str], resolve) -> DataFrame:
    """The same where seeds and bindings are facts (*on, node, evidence_key, ...) at the places ``on`` of ``points``.

    Points that share all their places have the same bindings, so a class of points is searched before its points come
    in.  ``resolve`` turns pairs of points (point_id, kind) and facts into seeds; a place's facts are told apart by
    their node and evidence_key.
    """
    rows = classed(points.select("point_id", "kind", *on), ["kind", *on])
    told = [c for c in facts.columns if c not in on]
    bound = class_facts(rows, bindings.select(*on, "node", "evidence_key"), on, ["node", "evidence_key"])
    free = class_facts(rows, facts, on, ["kind", *told]).join(bound, ["_places", "node", "evidence_key"], "left_anti").hint("merge")
    several = F.size("_places") > 1
    found = lambda of: resolve(rows.where(of).join(free, "_places")).select("point_id", "node", "evidence_key")
    return found(~several).union(found(several).distinct())


def prepare_structures(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structural references that count, and those that remain accessible, which are only observed."""
    accessible = F.coalesce(F.col("check") == "ACCESSIBLE", F.lit(False)) & F.col("kind").endswith("_ACCESS_NARROWED")
    return references.where(~accessible), references.where(accessible)


def structural_representatives(references: DataFrame, paths: DataFrame, on: tuple[str, ...] = ("point_id",), points: DataFrame | None = None) -> DataFrame:
    """(point_id, reference, affected_method, nodes, classification).

    A reference from PROJECT code is DIRECT, without nodes.  Of others the shortest path of each affected method stands,
    then that with the smallest nodes.  references (point_id, reference, origin), paths (point_id, reference,
    affected_method, nodes).  With ``points`` (point_id, origin, *on) references (*on, reference) and paths belong to
    places that many points may share: a place's best paths are found once, and of a point's places the best ones stand.
    """
    kind = paths.schema["nodes"].dataType.simpleString()
    rank = F.struct(F.size("nodes").alias("n"), "nodes")
    by = ["point_id", "reference", "affected_method"]
    if points is None:
        of = references.select("point_id", "reference", "origin").distinct()
        mine = of.where("origin = 'PROJECT'").select("point_id", "reference")
        other = paths.join(of.where("origin <> 'PROJECT'").select("point_id", "reference"), ["point_id", "reference"], "left_semi")
    else:
        place = list(on)
        points = points.select("point_id", "origin", *place).distinct()
        mine = points.where("origin = 'PROJECT'").join(references.select(*place, "reference").distinct(), place).select("point_id", "reference").distinct()
        least = paths.groupBy(*place, *by[1:]).agg(F.min(rank)["nodes"].alias("nodes"))
        other = points.where("origin <> 'PROJECT'").join(least.hint("merge"), place)
    direct = mine.select("point_id", "reference", F.lit(None).cast("string").alias("affected_method"), F.array().cast(kind).alias("nodes"), F.lit("DIRECT").alias("classification"))
    best = other.groupBy(*by).agg(F.min(rank)["nodes"].alias("nodes"))
    return direct.unionByName(best.withColumn("classification", F.lit("TRANSITIVE")))
