"""Which definition of a class wins, and which names conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ORIGIN_PRIORITY, ranked


def class_winners(defs: DataFrame) -> DataFrame:
    """The definition of the best origin; of equal origins the first scanned."""
    order = F.struct(ranked(F.col("origin"), ORIGIN_PRIORITY, 4).alias("p"), F.col("scan_ord"))
    best = F.min_by(F.struct("origin", "source_key", "digest"), order)
    return defs.groupBy("binary_name").agg(best["origin"].alias("origin"), best["source_key"].alias("source_key"), best["digest"].alias("digest"))


def class_conflicts(defs: DataFrame) -> DataFrame:
    """Names with two or more distinct definitions; other digests are a HIGH risk."""
    distinct = defs.select("binary_name", "origin", "source_key", "digest", "entry_name").distinct()
    rows = distinct.groupBy("binary_name").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("digest").alias("digests")).where("candidates > 1")
    return rows.select("binary_name", "candidates", F.when(F.col("digests") > 1, "HIGH").otherwise("LOW").alias("risk"))


def text_risk(candidates: DataFrame) -> DataFrame:
    """A11 override: where every candidate's text is there, the risk follows the texts."""
    rows = candidates.groupBy("binary_name").agg(F.bool_and(F.col("text").isNotNull()).alias("_all"), F.count_distinct("text").alias("_texts"), F.count_distinct("digest").alias("_digests"))
    return rows.select("binary_name", F.when(F.when(F.col("_all"), F.col("_texts")).otherwise(F.col("_digests")) > 1, "HIGH").otherwise("LOW").alias("risk"))


def effective_definitions(defs: DataFrame) -> DataFrame:
    """definitions whose source owns the name (or no one does); never module or versioned entries."""
    owners = class_winners(defs).select("binary_name", F.col("source_key").alias("_owner"))
    named = defs.where(~F.col("binary_name").rlike("(^|/)module-info$") & ~F.col("entry_name").startswith("META-INF/versions/"))
    return named.join(owners, "binary_name", "left").where(F.col("_owner").isNull() | (F.col("_owner") == F.col("source_key"))).drop("_owner")


def shadowed_changes(points: DataFrame, defs: DataFrame) -> DataFrame:
    """Change points whose artifact defines the class but does not win it."""
    winners = class_winners(defs).select("binary_name", F.col("source_key").alias("_winner"))
    losers = defs.join(winners, "binary_name").where("source_key <> _winner").select(F.col("binary_name").alias("owner"), F.col("source_key").alias("artifact")).distinct()
    return points.join(losers, ["owner", "artifact"], "left_semi")


def duplicate_probe(entries: DataFrame, indexed: DataFrame, wanted: Column) -> DataFrame:
    """Of an archive's entries only those whose name is indexed already and that the predicate wants are read."""
    return entries.where(wanted).join(indexed.select("binary_name").distinct(), "binary_name", "left_semi")


def candidate_entries(candidates: DataFrame, entries: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The candidates with their classpath entry, and those without one, which are issues."""
    return candidates.join(entries, keys), candidates.join(entries.select(*keys).distinct(), keys, "left_anti")
