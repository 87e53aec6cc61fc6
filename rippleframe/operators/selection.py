"""Named filters over class, member and dependency facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import DEFAULT_KINDS, entrypoint_selected


class EmptySelection(ValueError):
    """A selector that a user gave matches nothing."""


def entrypoint_classes(classes: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """no module descriptors, interfaces or private classes; raises where the selectors match nothing."""
    chosen = classes.where(~F.col("internal_name").endswith("module-info") & ~F.col("is_interface") & (F.col("access") != "PRIVATE") & entrypoint_selected(F.col("internal_name"), include, list(exclude)))
    if include and chosen.isEmpty():
        raise EmptySelection(f"no class matches {include}")
    return chosen


def entrypoint_counts(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(internal_name, n_methods) of the entry classes: all their methods that are neither private nor abstract, constructors too."""
    n = methods.where(~F.col("is_abstract") & (F.col("access") != "PRIVATE")).groupBy(F.col("owner").alias("internal_name")).agg(F.count(F.lit(1)).alias("n_methods"))
    return classes.select("internal_name").join(n, "internal_name", "left").na.fill(0, ["n_methods"])


def entrypoint_methods(methods: DataFrame) -> DataFrame:
    """F08."""
    return methods.where(~F.col("is_abstract") & (F.col("access") != "PRIVATE")).orderBy("owner", "name", "descriptor")


def of_kinds(points: DataFrame, kinds: list[str] = DEFAULT_KINDS) -> DataFrame:
    """F09."""
    return points.where(F.col("kind").isin(*kinds))


def jar_pairs(changes: DataFrame, scopes: list[str]) -> DataFrame:
    """Distinct version changes of jars on both sides in the scopes, and whether they risk a provided API."""
    rows = changes.where((F.col("change_type") == "VERSION_CHANGED") & (F.col("old_type") == "jar") & (F.col("new_type") == "jar") & F.col("scope").isin(*scopes))
    return rows.groupBy("old_coordinate", "new_coordinate").agg(F.bool_or(F.col("scope") == "provided").alias("provided_api_risk"), F.count_distinct("module_key").alias("modules"))


def all_points(*parts: DataFrame) -> DataFrame:
    """The change points of all sources, each once, in order."""
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.orderBy(*found.columns)


def pair_modules(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """What was found once for each pair of jars (``pairs``), joined back to every module that has the pair."""
    used = changes.select("module_key", "old_coordinate", "new_coordinate").distinct()
    return used.join(pairs, ["old_coordinate", "new_coordinate"])
