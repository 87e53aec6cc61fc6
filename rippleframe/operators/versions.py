"""Version, conflict and catalogue aggregates over dependency occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["group_id", "artifact_id"]
_blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""


def aggregate_dependencies(occ: DataFrame, module: list[str], path: str = "path") -> DataFrame:
    """By module and key, the first occurrence's version and scope, whether any path is direct, and the paths.

    Of the occurrences on one path the last stands: ``paths`` has each distinct path once with its version and scope, in
    order.
    """
    last = F.max_by(F.struct(F.col("effective_version").alias("version"), F.col("effective_scope").alias("scope")), "seq")
    each = occ.groupBy(*module, *KEY, path).agg(
        F.min_by(F.struct("selected_version", "effective_scope"), "seq").alias("_first"), F.min("seq").alias("_seq"), F.bool_or(F.col("depth") == 1).alias("_direct"), last.alias("_last")
    )
    first = F.min_by("_first", "_seq")
    paths = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), F.col("_last.version"), F.col("_last.scope"))))
    return each.groupBy(*module, *KEY).agg(
        first["selected_version"].alias("selected_version"), first["effective_scope"].alias("effective_scope"), F.bool_or("_direct").alias("direct"), F.count(F.lit(1)).alias("n_paths"), paths.alias("paths")
    )


def internal_conflicts(occ: DataFrame, module: list[str], complete: str | None = None) -> DataFrame:
    """Keys with two or more distinct versions among requested ones and, where managed, effective ones.

    Reports the first selected occurrence's version and scope (else the first one's), and on how many distinct paths
    which versions stand.  Modules whose mediation is incomplete (``complete`` false) give nothing.
    """
    rows = occ.where(F.col(complete)) if complete else occ
    rows = rows.withColumn("_v", F.explode(F.array_distinct(F.array("requested_version", F.when(~_blank(F.col("managed_from_version")), F.col("effective_version")).otherwise(F.col("requested_version"))))))
    rows = rows.where(~_blank(F.col("_v")))
    shown = F.min_by(F.struct("selected_version", "effective_scope"), F.struct(~F.col("selected"), F.col("seq")))
    found = rows.groupBy(*module, *KEY).agg(F.count_distinct("_v").alias("n_versions"), shown["selected_version"].alias("reported_version"), shown["effective_scope"].alias("reported_scope"), F.count_distinct("path", "_v").alias("version_paths"))
    return found.where("n_versions > 1")


def resolved_versions(occ: DataFrame, by: list[str]) -> DataFrame:
    """Distinct selected versions of selected rows, and of requested and selected ones over all rows."""
    use = lambda c, on=F.lit(True): F.when(on & ~_blank(F.col(c)), F.col(c))
    both = occ.withColumn("_any", F.explode(F.array("requested_version", "selected_version")))
    return both.groupBy(*by).agg(F.count_distinct(use("selected_version", F.col("selected"))).alias("resolved"), F.count_distinct(use("_any")).alias("unique_versions"))


def multi_version_by_module(occ: DataFrame, module: list[str]) -> DataFrame:
    """Of each module's selected keys, how many are resolved to several versions in the whole reactor."""
    many = resolved_versions(occ, KEY).where("resolved > 1").select(*KEY, F.lit(True).alias("_many"))
    return occ.where("selected").join(many, KEY, "left").groupBy(*module).agg(F.count_distinct(F.when(F.col("_many"), F.struct(*KEY))).alias("multi_version"), F.count_distinct(F.struct(*KEY)).alias("selected_keys"))


def reactor_summary(occ: DataFrame, conflicts: DataFrame, class_conflicts: DataFrame) -> DataFrame:
    """One row of totals."""
    many = resolved_versions(occ, KEY).where("resolved > 1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [
        occ.agg(F.count_distinct("module_key").alias("modules"), F.count(F.lit(1)).alias("occurrences")),
        one(conflicts, "internal_conflicts"), one(many, "multi_version"),
        class_conflicts.agg(F.count(F.lit(1)).alias("class_conflicts"), F.count_if(F.col("risk") == "HIGH").alias("high_class_conflicts")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # each side is one row
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
