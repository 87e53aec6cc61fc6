"""Report queries over affected paths, changed members and module sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import artifact_selected
from .report import ReportQuery

#: Fixed value: how many candidates a box shows.
CANDIDATES = 50


def contains(text: str, *columns: Column) -> Column:
    """Any of the columns has the text in any letter case; a blank text fits everything."""
    wanted = text.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False)) for c in columns)), F.lit(False))


def module_section(rows: DataFrame, module: str, search: str = "", risk: str | None = None, order: tuple = (), size: int = 50, page: int = 0) -> DataFrame:
    """Q02: one module's rows (module_key, search_text, risk if there are risks), filtered, ordered and paged."""
    query = ReportQuery(rows, known={"risk": {"HIGH", "LOW"}}).exact("module_key", module).search(search, "search_text").exact("risk", risk)
    return query.sorted(*order).paged(size, page).result()


def affected_paths(paths: DataFrame, include: list[str] = (), exclude: list[str] = (), dependency: str | None = None, member: str | None = None, method: str | None = None, search: str = "") -> DataFrame:
    """Q03: paths (source, dependency, member, affected_methods, search_text) that fit all filters.

    The scope is a pair of glob lists over the source, an exclude wins; the dependency (by its source), the changed
    member and the affected method must be exactly the given ones; the search looks into the path's text, the member,
    the dependency's label and the source.
    """
    conditions = [artifact_selected(F.col("source"), list(include), list(exclude)), contains(search, F.col("search_text"), F.col("member"), F.col("dependency"), F.col("source"))]
    conditions += [F.col("source") == dependency] if dependency else []
    conditions += [F.col("member") == member] if member else []
    conditions += [F.array_contains("affected_methods", method)] if method else []
    return reduce(DataFrame.where, conditions, paths)


def view_type(paths: DataFrame, kind: str = "all") -> DataFrame:
    """Q04: impact or structural paths of a result, or all; the filters that made it need not run again on other columns."""
    if kind not in ("all", "impact", "structural"):
        raise ValueError(f"unknown view: {kind}")
    return paths if kind == "all" else paths.where(F.col("path_kind") == kind)


def member_order() -> list[Column]:
    """Most paths first, then most impact and structural ones, then by id."""
    return [F.desc("total"), F.desc("impact"), F.desc("structural"), F.col("member_id")]


def changed_members(members: DataFrame, kind: str = "all", chain: str = "all", dependency: str | None = None, member: str | None = None, include: list[str] = (), exclude: list[str] = (), search: str = "") -> DataFrame:
    """Q05: members (member_id, kind, source, dependency, signature, impact, structural) with ``total``, filtered and ordered.

    ``chain`` is ``has`` for members with any path, ``none`` for those without.
    """
    if chain not in ("all", "has", "none"):
        raise ValueError(f"unknown chain: {chain}")
    rows = members.withColumn("total", F.col("impact") + F.col("structural"))
    conditions = [artifact_selected(F.col("source"), list(include), list(exclude)), contains(search, F.concat_ws(" ", "dependency", "source", "signature"))]
    conditions += [F.col("kind") == kind] if kind != "all" else []
    conditions += [F.col("total") > 0] if chain == "has" else [F.col("total") == 0] if chain == "none" else []
    conditions += [F.col("source") == dependency] if dependency else []
    conditions += [F.col("signature") == member] if member else []
    return reduce(DataFrame.where, conditions, rows).orderBy(*member_order())


def candidates(items: DataFrame, text: str, label: str = "label", order: tuple = (), n: int = CANDIDATES) -> DataFrame:
    """Q08: the first items whose label has the text, in the items' order."""
    return items.where(contains(text, F.col(label))).orderBy(*(order or (label,))).limit(n)


def intersect_ranges(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The [start, stop) ranges that both sides have; each side may overlap itself.

    Every range counts up at its start and down at its stop; between two neighbouring borders both sides' counts must be
    above zero.  Touching results are one.
    """
    border = lambda df, at, l, r: df.select(*by, F.col(at).alias("at"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    full = lambda df: df.where("stop > start")
    steps = reduce(DataFrame.union, (border(full(left), "start", 1, 0), border(full(left), "stop", -1, 0), border(full(right), "start", 0, 1), border(full(right), "stop", 0, -1)))
    steps = steps.groupBy(*by, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy(*by).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    open_ = steps.withColumns({"both": (F.sum("l").over(so_far) > 0) & (F.sum("r").over(so_far) > 0), "stop": F.lead("at").over(order)})
    opens = open_.withColumn("first", F.when(F.col("both") & ~F.coalesce(F.lag("both").over(order), F.lit(False)), 1).otherwise(0)).where("both")
    runs = opens.withColumn("run", F.sum("first").over(so_far))
    return runs.groupBy(*by, "run").agg(F.min("at").alias("start"), F.max("stop").alias("stop")).drop("run")


def bounded_examples(rows: DataFrame, by: list[str], example: str, n: int) -> DataFrame:
    """Of each group the number of examples and the ``n`` smallest distinct ones, joined by a comma."""
    w = Window.partitionBy(*by).orderBy(example)
    few = rows.select(*by, example).distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    listed = few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(example)), ", ").alias("examples"))
    return rows.groupBy(*by).agg(F.count_distinct(example).alias("n_examples")).join(listed, by)


def boundary_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """DEPENDENCY nodes (origin, no_op, factory, retained) with a real body, without one, made by a factory, and retained ones."""
    own = nodes.where("origin = 'DEPENDENCY'")
    return own.groupBy(*by).agg(
        F.count_if(~F.col("no_op")).alias("real_nodes"), F.count_if(F.col("no_op") & ~F.col("factory")).alias("no_op_nodes"), F.count_if(F.col("no_op") & F.col("factory")).alias("factory_nodes"),
        F.count_if(~F.col("no_op") & F.col("retained")).alias("retained_nodes"),
    )


def peaks(samples: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """The peak of each sampled pool and when it was reached first."""
    return samples.groupBy(*by).agg(F.max(value).alias("peak"), F.min_by(at, F.struct((-F.col(value)).alias("v"), F.col(at).alias("t"))).alias("reached"))
