"""Report projections: facts as numbered records, and posting lists of their ids as ranges.

Every list of ids (the rows of a dependency, a scope, a source, a member) is a few ranges of consecutive ids, themselves
numbered records; a descriptor says which ranges a list has.  A filter on two lists is the intersection of their ranges.
Numbers come from range sorts with a start for each partition, so no kind and no list is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import resolution_detail, resolution_source
from ..operators.steps import step
from .affected import intersect_ranges
from .report import dense_ids, numbered


class Records(Mapping):
    """A projection's kinds of records by name, each put together when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = {name.replace("_", "-"): cache(maker) for name, maker in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def posting_ranges(postings: DataFrame, of: list[str], id_column: str = "id") -> DataFrame:
    """(range_id, *of, start, n): each list's runs of consecutive ids, numbered by list and start.

    One range sort by list and id: an id opens a run unless the row before it, in its partition or at the end of the one
    before, has the id before it in the same list.  Runs are counted in each partition, from the sum of the partitions
    before it; what a partition begins with may belong to the last run before it.  Repeated ids count once.
    """
    names = [*of, "_id"]
    partitions = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = step(postings.select(*of, F.col(id_column).alias("_id")).repartitionByRange(partitions, *names).withColumn("_part", F.spark_partition_id()))
    lasts = parts.groupBy("_part").agg(F.max(F.struct(*names)).alias("_l"))
    before = lasts.select("_part", F.lag("_l").over(Window.orderBy("_part")).alias("_before"))  # a row for each partition
    local = Window.partitionBy("_part").orderBy(*names)
    rows = parts.join(F.broadcast(before), "_part").withColumn("_p", F.coalesce(F.lag(F.struct(*names)).over(local), F.col("_before")))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_p.{c}")) for c in of))
    follows = F.col("_p").isNotNull() & same & (F.col("_p._id") >= F.col("_id") - 1)
    runs = rows.withColumn("_opens", F.when(follows, 0).otherwise(1)).withColumn("_nth", F.sum("_opens").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = step(runs.groupBy("_part", "_nth").agg(*(F.first(c).alias(c) for c in of), F.min("_id").alias("start"), F.max("_id").alias("_last")))
    counts = pieces.groupBy("_part").agg(F.max("_nth").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    pieces = pieces.join(F.broadcast(starts), "_part").withColumn("range_id", F.col("_start") + F.col("_nth") - 1)
    more = pieces.where("_nth = 0").groupBy("range_id").agg(F.max("_last").alias("_more"))  # at most one for each partition
    return pieces.where("_nth > 0").join(F.broadcast(more), "range_id", "left").select("range_id", *of, "start", (F.greatest("_last", "_more") - F.col("start") + 1).alias("n"))


def range_descriptors(ranges: DataFrame, of: list[str]) -> DataFrame:
    """(*of, first_range, n_ranges)."""
    return ranges.groupBy(*of).agg(F.min("range_id").alias("first_range"), F.count(F.lit(1)).alias("n_ranges"))


def expanded(ranges: DataFrame, id_column: str = "id") -> DataFrame:
    """The ids of [start, stop) ranges: as many rows as the result."""
    return ranges.where("stop > start").select(F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias(id_column))


def tree_projection(occurrences: DataFrame) -> Records:
    """The records of one reactor's trees from (module_key, seq, dependency, scope, path, requested_version,
    effective_version, selected_version, managed_from_version, omitted_reason, selected), in the order of (module_key, seq).

    ``rows``: numbered occurrences with their texts; ``ranges``: posting lists of the dependencies and, behind them, of
    the scopes; ``catalog``: each module's dependencies with their numbers of resolved and of all versions;
    ``dependencies``, ``scopes``, ``modules``: descriptors.  A dependency is one of many versions if more than one is
    selected for it in the reactor; modules count those that they select.  ``named`` are the dependencies' names.
    """
    names = ["module_key", "seq", "dependency", "scope", "path", "requested_version", "effective_version", "selected_version", "managed_from_version", "omitted_reason", "selected"]
    occurrences = step(occurrences.select(*names))  # numbers, ids and samples of the sort all read them
    ids = dense_ids(occurrences.select("dependency"), ["dependency"], "dependency_id")
    modules = dense_ids(occurrences.select("module_key"), ["module_key"], "module_id")
    rows = numbered(occurrences.join(ids, "dependency").join(modules, "module_key"), ["module_id", "seq"], "row_id")
    detail = resolution_detail(*map(F.col, ("requested_version", "effective_version", "selected_version", "managed_from_version", "selected", "omitted_reason")))
    source = resolution_source(*map(F.col, ("managed_from_version", "selected", "omitted_reason")))
    search = F.lower(F.concat_ws(" ", "dependency", "scope", "module_key", "path", "requested_version", "selected_version", source, detail))
    records = rows.select("row_id", "dependency_id", "module_id", "scope", F.col("path").alias("chain"), F.col("requested_version").alias("original"), F.col("selected_version").alias("resolved"), source.alias("source"), detail.alias("detail"), search.alias("search_text"))
    full = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    resolved = F.count_distinct(F.when(F.col("selected") & full("selected_version"), F.col("selected_version"))).alias("resolved")
    unique = F.count_distinct(F.when(full("_version"), F.col("_version"))).alias("versions")
    versions = lambda *by: rows.withColumn("_version", F.explode(F.array("requested_version", "selected_version"))).groupBy(*by).agg(unique)

    @cache
    def ranges():
        lists = rows.select(F.lit(0).alias("list"), F.col("dependency_id").alias("key"), F.lit("").alias("scope"), "row_id").union(rows.select(F.lit(1), F.lit(None).cast("long"), "scope", "row_id"))
        return step(posting_ranges(lists, ["list", "key", "scope"], "row_id"))

    @cache
    def catalog():
        by = ["module_id", "dependency_id"]
        return step(numbered(rows.groupBy(*by).agg(resolved).join(versions(*by), by), by, "catalog_id"))

    def dependencies():
        known = rows.groupBy("dependency_id", "dependency").agg(resolved).join(versions("dependency_id"), "dependency_id")
        return known.join(range_descriptors(ranges().where("list = 0").withColumnRenamed("key", "dependency_id"), ["dependency_id"]), "dependency_id")

    def described():
        several = rows.groupBy("dependency_id").agg(resolved).where("resolved > 1").select("dependency_id")
        many = rows.where("selected").join(several, "dependency_id", "left_semi").groupBy("module_id").agg(F.count_distinct("dependency_id").alias("multi_version"))
        found = rows.groupBy("module_id", "module_key").agg(F.min("row_id").alias("first_row"), F.count(F.lit(1)).alias("n_rows"))
        found = found.join(catalog().groupBy("module_id").agg(F.min("catalog_id").alias("first_dependency"), F.count(F.lit(1)).alias("n_dependencies")), "module_id").join(many, "module_id", "left")
        return found.withColumn("multi_version", F.coalesce("multi_version", F.lit(0)).cast("long"))

    return Records(
        rows=lambda: records, ranges=ranges, catalog=lambda: catalog().select("catalog_id", "module_id", "dependency_id", "resolved", "versions"), dependencies=dependencies,
        scopes=lambda: range_descriptors(ranges().where("list = 1"), ["scope"]), modules=described, named=lambda: rows.select("dependency_id", "dependency").distinct(),
    )


def rows_of(projection: Mapping[str, DataFrame], dependency: str, scope: str) -> DataFrame:
    """Q02 by posting lists: the records of a dependency in a scope, found by intersecting the two lists' ranges."""
    spans = lambda rows: rows.select(F.lit(0).alias("_of"), "start", (F.col("start") + F.col("n")).alias("stop"))
    wanted = projection["named"].where(F.col("dependency") == dependency).select(F.col("dependency_id").alias("key"))
    left = projection["ranges"].where("list = 0").join(wanted, "key", "left_semi")
    right = projection["ranges"].where(F.col("list") == 1).where(F.col("scope") == scope)
    return projection["rows"].join(expanded(intersect_ranges(spans(left), spans(right), ["_of"]), "row_id"), "row_id", "left_semi")


def affected_path_projection(paths: DataFrame, members: DataFrame, leads: DataFrame | None = None) -> Records:
    """The records of a module's affected paths.

    ``paths`` (path_kind, path_key, member_key, classification, root_kind, nodes array of (key, label, project),
    affected_methods, search_text, application_member, relation, changed_class) has a row for each member a path leads
    to; ``members`` (member_key, kind, signature, dependency_key, old_artifact, new_artifact, scope, source, status,
    diff) is the module's changed members.  Impact paths stand before structural ones, each by key; of paths that share
    a key the least row stands.  ``rows`` are the pairs of a path and a member; members and sources know their rows as
    ranges.  ``leads``, distinct (path_kind, path_key, member_key), tells the members apart from the paths; where it is
    given, a path needs no row for each member.  A member whose comparison is missing is UNAVAILABLE; only AVAILABLE
    ones have a diff record.
    """
    member_ids = dense_ids(members.select("member_key"), ["member_key"], "member_id")
    dependency_ids = dense_ids(members.select("dependency_key"), ["dependency_key"], "dependency_id")
    own = step(members.join(member_ids, "member_key").join(dependency_ids, "dependency_key"))
    facts = ["classification", "root_kind", "nodes", "affected_methods", "search_text", "application_member", "relation", "changed_class"]
    structural = F.when(F.col("path_kind") == "structural", 1).otherwise(0)
    single = paths.groupBy("path_kind", "path_key").agg(F.min(F.struct(*facts)).alias("_f")).select(structural.alias("_structural"), "path_kind", "path_key", "_f.*")
    single = step(numbered(single, ["_structural", "path_key"], "path_id"))
    node = single.select(F.explode("nodes").alias("n")).select("n.key", "n.label", "n.project")
    method_ids = dense_ids(node.select("key"), ["key"], "method_id")
    methods = node.groupBy("key").agg(F.min(F.struct("label", "project")).alias("m")).join(method_ids, "key").select("method_id", "m.label", "m.project")
    leads = paths.select("path_kind", "path_key", "member_key").distinct() if leads is None else leads
    pairs = leads.join(single.select("path_kind", "path_key", "path_id"), ["path_kind", "path_key"]).join(own.select("member_key", "member_id", "source"), "member_key")
    rows = step(numbered(pairs.select("path_id", "member_id", "path_kind", "source"), ["path_id", "member_id"], "row_id"))
    of_path = rows.groupBy("path_id").agg(F.min("row_id").alias("row_start"), F.count(F.lit(1)).alias("row_count"))
    placed = single.select("path_id", F.posexplode("nodes").alias("_at", "_n")).select("path_id", "_at", F.col("_n.key").alias("key")).join(method_ids, "key")
    chain = placed.groupBy("path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "method_id"))), lambda x: x["method_id"]).alias("method_ids"))
    sources = cache(lambda: step(posting_ranges(rows, ["source"], "row_id")))
    status = F.coalesce("status", F.lit("UNAVAILABLE"))
    diffs = cache(lambda: numbered(own.where(status == "AVAILABLE").select("member_id", "diff"), ["member_id"], "diff_id"))

    def described():
        by_member = posting_ranges(rows, ["member_id"], "row_id").groupBy("member_id").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("row_ranges"))
        none = F.array().cast("array<struct<start:bigint,n:bigint>>")
        found = own.join(diffs().select("member_id", "diff_id"), "member_id", "left").join(by_member, "member_id", "left")
        return found.select("member_id", "dependency_id", "kind", "signature", status.alias("status"), "diff_id", F.coalesce("row_ranges", none).alias("row_ranges"))

    cycle = (F.col("root_kind") == "STRONGLY_CONNECTED_COMPONENT").alias("cycle")
    return Records(
        index=lambda: single.join(of_path, "path_id").select("path_id", F.col("path_kind").alias("type"), "search_text", "affected_methods", "row_start", "row_count"),
        source_index=lambda: sources().select("range_id", "start", "n"), rows=lambda: rows.select("row_id", "path_id", "member_id"),
        paths=lambda: single.join(chain, "path_id", "left").select("path_id", F.col("path_kind").alias("type"), "classification", "root_kind", cycle, "application_member", "relation", "changed_class", "method_ids"),
        methods=lambda: methods, members=described, diffs=lambda: diffs().select("diff_id", "diff"), sources=lambda: range_descriptors(sources(), ["source"]),
        dependencies=lambda: own.groupBy("dependency_id").agg(*(F.min(c).alias(c) for c in ("old_artifact", "new_artifact", "scope", "source"))),
    )
