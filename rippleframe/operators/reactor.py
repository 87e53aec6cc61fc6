"""Which modules of a repository are analysed together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import reach


class InvalidScope(ValueError):
    """A scope whose modules cannot be told apart."""


def folder(pom: Column) -> Column:
    return F.regexp_replace(pom, r"(^|/)pom\.xml$", "")


def module_pom(owner: Column, module: Column) -> Column:
    """The POM that a module entry of ``owner`` names: a folder's, or a file ``pom.xml`` itself; ``.`` and ``..`` resolved."""
    joined = F.concat_ws("/", F.nullif(folder(owner), F.lit("")), module)
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    path = F.array_join(walked, "/")
    return F.when(module.isNull(), None).when(path.rlike(r"(^|/)pom\.xml$"), path).otherwise(F.concat_ws("/", F.nullif(path, F.lit("")), F.lit("pom.xml")))


def active_closure(poms: DataFrame) -> DataFrame:
    """(root, pom): each POM and what its active modules lead to; poms has path and active_modules."""
    edges = poms.select(F.col("path").alias("src"), F.explode("active_modules").alias("m")).select("src", module_pom(F.col("src"), F.col("m")).alias("dst"))
    return reach(edges, poms.select(F.col("path").alias("node"))).select(F.col("seed").alias("root"), F.col("node").alias("pom"))


def reactor_scopes(poms: DataFrame, requested: DataFrame) -> DataFrame:
    """(requested, mode, root_pom, active_poms) for every requested POM (path).

    A POM with active modules is its own FULL_REACTOR.  Else the outermost POM in a folder above whose active closure
    holds it makes it a SINGLE_MODULE of that scope; without one it is STANDALONE.
    """
    closure = active_closure(poms)
    asked = requested.select(F.col("path").alias("requested")).join(poms.select(F.col("path").alias("requested"), (F.size("active_modules") > 0).alias("_full")), "requested")
    depth = F.when(folder(F.col("root")) == "", 0).otherwise(F.size(F.split(folder(F.col("root")), "/")))
    above = (folder(F.col("root")) == "") | folder(F.col("requested")).startswith(F.concat(folder(F.col("root")), F.lit("/")))
    owners = asked.where("NOT _full").join(closure.withColumnRenamed("pom", "requested"), "requested").where((F.col("root") != F.col("requested")) & above)
    outermost = owners.groupBy("requested").agg(F.min_by("root", F.struct(depth, "root")).alias("_owner"))
    scoped = asked.join(outermost, "requested", "left").withColumns({
        "mode": F.when(F.col("_full"), "FULL_REACTOR").when(F.col("_owner").isNotNull(), "SINGLE_MODULE").otherwise("STANDALONE"),
        "root_pom": F.coalesce("_owner", "requested"),
    })
    members = closure.groupBy(F.col("root").alias("root_pom")).agg(F.array_sort(F.collect_list("pom")).alias("_members"))
    active = F.when(F.col("mode") == "STANDALONE", F.array("requested")).otherwise(F.col("_members"))
    return scoped.join(members, "root_pom", "left").select("requested", "mode", "root_pom", active.alias("active_poms"))


def scope_problems(scopes: DataFrame, poms: DataFrame) -> DataFrame:
    """(requested, problem, key): coordinates that are not whole, and group:artifact keys on two active POMs."""
    each = scopes.select("requested", F.explode("active_poms").alias("path")).join(poms.select("path", "coordinate"), "path", "left")
    parts = F.split("coordinate", ":")
    whole = (F.size(parts) == 3) & F.forall(parts, lambda p: (F.trim(p) != "") & (p != "?") & ~p.contains("${"))
    bad = each.where(~F.coalesce(whole, F.lit(False))).select("requested", F.lit("INVALID_COORDINATE").alias("problem"), F.coalesce("coordinate", "path").alias("key"))
    twice = each.where(whole).groupBy("requested", F.concat_ws(":", parts[0], parts[1]).alias("key")).agg(F.count_distinct("path").alias("n")).where("n > 1")
    return bad.union(twice.select("requested", F.lit("DUPLICATE_MODULE").alias("problem"), "key"))
