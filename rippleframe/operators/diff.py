"""Two-sided differences: dependency trees, resolved dependencies, chains, classes and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ACCESS_RANK, CHANGE_KINDS, CHANGE_TYPE_ORDER, ranked
from .graph import reach


def two_sided(baseline: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on ``keys``; other columns get b_ and t_ before their names, in_b and in_t tell the sides.

    The sides are told by marker columns, never by a column that may itself be null.
    """
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys), F.lit(True).alias(f"in_{p}"))
    joined = side(baseline, "b").join(side(target, "t"), keys, "full_outer")
    return joined.withColumns({m: F.coalesce(m, F.lit(False)) for m in ("in_b", "in_t")})


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of equal keys the row that comes first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dependency_changes(baseline: DataFrame, target: DataFrame, keys: list[str], version: str = "version", scope: str = "scope") -> DataFrame:
    """ADDED, REMOVED and VERSION_CHANGED; equal versions give nothing; the scope is the target's unless removed."""
    both = two_sided(baseline.select(*keys, version, scope), target.select(*keys, version, scope), keys)
    kind = F.when(~F.col("in_b"), "ADDED").when(~F.col("in_t"), "REMOVED").when(~F.col(f"b_{version}").eqNullSafe(F.col(f"t_{version}")), "VERSION_CHANGED")
    rows = both.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
    return rows.select(*keys, "change_type", F.col(f"b_{version}").alias("old_version"), F.col(f"t_{version}").alias("new_version"), F.when(F.col("in_t"), F.col(f"t_{scope}")).otherwise(F.col(f"b_{scope}")).alias("scope"), ranked(F.col("change_type"), CHANGE_TYPE_ORDER, 9).alias("change_order"))


def tree_diff(baseline: DataFrame, target: DataFrame, keys: list[str], version: str = "version", scope: str = "scope") -> DataFrame:
    """As D01, but unchanged rows are given too, and a change of scope is told apart from the base type."""
    both = two_sided(baseline.select(*keys, version, scope), target.select(*keys, version, scope), keys)
    kind = F.when(~F.col("in_b"), "ADDED").when(~F.col("in_t"), "REMOVED").when(F.col(f"b_{version}").eqNullSafe(F.col(f"t_{version}")), "RESOLVED_UNCHANGED").otherwise("VERSION_CHANGED")
    moved = F.col("in_b") & F.col("in_t") & ~F.col(f"b_{scope}").eqNullSafe(F.col(f"t_{scope}"))
    return both.select(*keys, kind.alias("base_type"), moved.alias("scope_changed"), F.col(f"b_{version}").alias("old_version"), F.col(f"t_{version}").alias("new_version"))


def diff_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each base type and of changed scopes."""
    count = lambda kind: F.count_if(F.col("base_type") == kind).alias(kind.lower())
    return rows.groupBy(*by).agg(*map(count, ("ADDED", "REMOVED", "VERSION_CHANGED", "RESOLVED_UNCHANGED")), F.count_if("scope_changed").alias("scope_changed"))


def gated_metrics(rows: DataFrame, statuses: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of every module in ``statuses``: null where it is not COMPARABLE, zero where nothing differs."""
    counts = diff_metrics(rows.join(statuses.where("status = 'COMPARABLE'").select(*by), by, "left_semi"), by)
    names = [c for c in counts.columns if c not in by]
    joined = statuses.select(*by, "status").join(counts, by, "left")
    return joined.select(*by, "status", *(F.when(F.col("status") == "COMPARABLE", F.coalesce(c, F.lit(0))).alias(c) for c in names))


def total_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the sums over the modules that have metrics; null ones are passed over."""
    names = [c for c in metrics.columns if c in ("added", "removed", "version_changed", "resolved_unchanged", "scope_changed")]
    return metrics.agg(F.count("added").alias("modules"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))


def chain_diff(baseline: DataFrame, target: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Paths without their root, of dependency keys alone, on either side; an array column is the join key."""
    paths = lambda df: df.select(*keys, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))).alias("chain")).distinct()
    both = two_sided(paths(baseline), paths(target), [*keys, "chain"])
    return both.select(*keys, "chain", F.when(~F.col("in_b"), "ADDED").when(~F.col("in_t"), "REMOVED").otherwise("UNCHANGED").alias("status"))


def comparability(baseline: DataFrame, target: DataFrame, keys: list[str], available: str = "available") -> DataFrame:
    """UNAVAILABLE if a present side is, COMPARABLE if both are there, else STRUCTURE_MISMATCH."""
    both = two_sided(baseline.select(*keys, available), target.select(*keys, available), keys)
    missing = (F.col("in_b") & ~F.coalesce(F.col(f"b_{available}"), F.lit(False))) | (F.col("in_t") & ~F.coalesce(F.col(f"t_{available}"), F.lit(False)))
    return both.select(*keys, F.when(missing, "UNAVAILABLE").when(F.col("in_b") & F.col("in_t"), "COMPARABLE").otherwise("STRUCTURE_MISMATCH").alias("status"))


def _narrowed(old: Column, new: Column) -> Column:
    return ranked(new, ACCESS_RANK, -1) < ranked(old, ACCESS_RANK, -1)


def class_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """(owner, access) on both sides to (owner, kind)."""
    both = two_sided(baseline.select("owner", "access"), target.select("owner", "access"), ["owner"])
    kind = F.when(~F.col("in_b"), "CLASS_ADDED").when(~F.col("in_t"), "CLASS_REMOVED").when(_narrowed(F.col("b_access"), F.col("t_access")), "CLASS_ACCESS_NARROWED")
    return both.select("owner", kind.alias("kind")).where("kind is not null")


def method_diff(baseline: DataFrame, target: DataFrame, kinds: list[str] = CHANGE_KINDS, suppressed: DataFrame | None = None) -> DataFrame:
    """(owner, name, descriptor, access, body_hash) to (owner, name, kind, old_descriptor, new_descriptor).

    Members are compared in classes of both sides alone.  A name with one method on each side and other descriptors is a
    descriptor change if that kind is asked for, else a removal and an addition.  A method may give a body change and a
    narrowed access; ``suppressed`` (owner, name, descriptor) drops body changes that are known to mean nothing.
    """
    shared = baseline.select("owner").intersect(target.select("owner"))
    b, t = baseline.join(shared, "owner", "left_semi"), target.join(shared, "owner", "left_semi")
    single = lambda df, p: df.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("descriptor").alias(f"{p}_descriptor")).where("n = 1").drop("n")
    moved = single(b, "old").join(single(t, "new"), ["owner", "name"]).where("old_descriptor <> new_descriptor")
    if "METHOD_DESCRIPTOR_CHANGED" not in kinds:
        moved = moved.limit(0)
    both = two_sided(b, t, ["owner", "name", "descriptor"]).join(moved.select("owner", "name"), ["owner", "name"], "left_anti")
    body = F.col("b_body_hash").isNotNull() & F.col("t_body_hash").isNotNull() & (F.col("b_body_hash") != F.col("t_body_hash"))
    found = F.array_compact(F.array(
        F.when(~F.col("in_b"), "METHOD_ADDED"), F.when(~F.col("in_t"), "METHOD_REMOVED"),
        F.when(F.col("in_b") & F.col("in_t") & body, "METHOD_BODY_CHANGED"),
        F.when(F.col("in_b") & F.col("in_t") & (F.col("name") != "<clinit>") & _narrowed(F.col("b_access"), F.col("t_access")), "METHOD_ACCESS_NARROWED"),
    ))
    rows = both.select("owner", "name", F.explode(found).alias("kind"), F.when(F.col("in_b"), F.col("descriptor")).alias("old_descriptor"), F.when(F.col("in_t"), F.col("descriptor")).alias("new_descriptor"))
    rows = rows.unionByName(moved.withColumn("kind", F.lit("METHOD_DESCRIPTOR_CHANGED")))
    if suppressed is not None:
        same = suppressed.select("owner", "name", F.col("descriptor").alias("new_descriptor"), F.lit("METHOD_BODY_CHANGED").alias("kind"))
        rows = rows.join(same, ["owner", "name", "new_descriptor", "kind"], "left_anti").select("owner", "name", "kind", "old_descriptor", "new_descriptor")
    return rows.where(F.col("kind").isin(*kinds))


def field_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """By name alone; a narrowed access counts where the descriptor is the same."""
    shared = baseline.select("owner").intersect(target.select("owner"))
    both = two_sided(baseline.join(shared, "owner", "left_semi"), target.join(shared, "owner", "left_semi"), ["owner", "name"])
    kind = (
        F.when(~F.col("in_b"), "FIELD_ADDED").when(~F.col("in_t"), "FIELD_REMOVED").when(F.col("b_descriptor") != F.col("t_descriptor"), "FIELD_DESCRIPTOR_CHANGED")
        .when(_narrowed(F.col("b_access"), F.col("t_access")), "FIELD_ACCESS_NARROWED")
    )
    return both.select("owner", "name", kind.alias("kind"), F.col("b_descriptor").alias("old_descriptor"), F.col("t_descriptor").alias("new_descriptor")).where("kind is not null")


def removed_registrations(baseline: DataFrame, target: DataFrame, valid: DataFrame, removed_classes: DataFrame) -> DataFrame:
    """Registrations (service, provider) that only the baseline has, of valid providers whose class remains.

    ``suppressed`` tells those whose class is removed itself: they are listed, but are no change points.
    """
    gone = baseline.select("service", "provider").distinct().join(valid.select("provider").distinct(), "provider", "left_semi").join(target.select("service", "provider"), ["service", "provider"], "left_anti")
    marked = removed_classes.select(F.col("owner").alias("provider"), F.lit(True).alias("_gone")).distinct()
    return gone.join(marked, "provider", "left").select("service", "provider", F.coalesce("_gone", F.lit(False)).alias("suppressed"))


def valid_providers(registrations: DataFrame, classes: DataFrame, parents: DataFrame) -> DataFrame:
    """The registrations (artifact, service, provider) whose provider can be loaded.

    The provider is a concrete public class of the artifact with a public constructor without arguments, and the service
    is among its ancestors.  The walk goes through classes of the same artifact alone; a name outside it counts once it
    is reached.  classes: artifact, owner, is_public, is_abstract, has_constructor; parents: artifact, sub, super.
    """
    usable = classes.where("is_public AND NOT is_abstract AND has_constructor").select("artifact", F.col("owner").alias("provider"))
    asked = registrations.select("artifact", "service", "provider").distinct().join(usable, ["artifact", "provider"], "left_semi")
    one = lambda c: F.struct("artifact", F.col(c).alias("name"))
    known = classes.select("artifact", F.col("owner").alias("sub")).distinct()
    steps = parents.join(known, ["artifact", "sub"], "left_semi").select(one("sub").alias("src"), one("super").alias("dst"))
    above = reach(steps, asked.select(one("provider").alias("node")))
    found = above.select(F.col("seed.artifact").alias("artifact"), F.col("seed.name").alias("provider"), F.col("node.name").alias("service")).distinct()
    return asked.join(found, ["artifact", "provider", "service"], "left_semi").select("artifact", "service", "provider")


def ordered_changes(changes: DataFrame, by: list[str]) -> DataFrame:
    """Changes by their first key (the module), then by kind of change, then by the other keys."""
    return changes.orderBy(by[0], "change_order", *by[1:])


def text_identical(old: Column, new: Column) -> Column:
    """IDENTICAL, DIFFERENT or UNKNOWN after line ends are made equal."""
    even = lambda c: F.regexp_replace(c, "\r\n?", "\n")
    return F.when(old.isNull() | new.isNull(), "UNKNOWN").when(even(old) == even(new), "IDENTICAL").otherwise("DIFFERENT")
