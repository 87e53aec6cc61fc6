"""POM files as tables: local parents, interpolated coordinates, and the modules that active profiles add."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import jdk_in_range, os_family, os_value, os_version, property_active
from ..operators.steps import step
from ..operators.reactor import InvalidScope, folder, module_pom
from .facts import active_profiles

_PROFILE = "struct<id:string,by_default:boolean,jdk:string,os_name:string,os_arch:string,os_version:string,os_family:string,has_os:boolean,property:string,value:string,has_property:boolean,exists:string,missing:string,has_file:boolean,modules:array<string>>"
_RAW = f"file string, group_id string, artifact_id string, version string, packaging string, parent_group string, parent_version string, parent_path string, properties map<string,string>, modules array<string>, profiles array<{_PROFILE}>"


def _parse(content: bytes) -> dict:
    """The parts of one POM that matter; a document type is refused before anything is parsed."""
    import re
    from xml.etree import ElementTree

    if re.search(rb"<!DOCTYPE", content, re.I):
        raise ValueError("a POM must not have a document type")
    root = ElementTree.fromstring(content)
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    child = lambda e, name: next((c for c in e if bare(c) == name), None) if e is not None else None
    text = lambda e, name: (child(e, name).text or "").strip() if child(e, name) is not None else None
    listed = lambda e: [m.text.strip() for m in (child(e, "modules") if child(e, "modules") is not None else ()) if (m.text or "").strip()]
    parent = child(root, "parent")
    relative = None if parent is None else "../pom.xml" if child(parent, "relativePath") is None else text(parent, "relativePath")
    profiles = []
    for p in child(root, "profiles") if child(root, "profiles") is not None else ():
        a = child(p, "activation")
        os_, prop, file = child(a, "os"), child(a, "property"), child(a, "file")
        profiles.append({
            "id": text(p, "id"), "by_default": (text(a, "activeByDefault") or "").lower() == "true", "jdk": text(a, "jdk"), "os_name": text(os_, "name"), "os_arch": text(os_, "arch"), "os_version": text(os_, "version"),
            "os_family": text(os_, "family"), "has_os": os_ is not None, "property": text(prop, "name") or "", "value": text(prop, "value"), "has_property": prop is not None,
            "exists": text(file, "exists"), "missing": text(file, "missing"), "has_file": file is not None, "modules": listed(p),
        })
    own = child(root, "properties")
    return {
        "group_id": text(root, "groupId"), "artifact_id": text(root, "artifactId"), "version": text(root, "version"), "packaging": text(root, "packaging"), "parent_group": text(parent, "groupId"), "parent_version": text(parent, "version"),
        "parent_path": relative or None, "properties": {bare(e): (e.text or "").strip() for e in (own if own is not None else ())}, "modules": listed(root), "profiles": profiles,
    }


def interpolated(value: Column, properties: Column) -> Column:
    """Every ``${name}`` of the map replaced by its value, once; other names stay."""
    return F.aggregate(F.map_entries(properties), value, lambda acc, e: F.replace(acc, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))


def command_line(arguments: list[str]) -> dict:
    """The keyword arguments of ``read_poms`` that a build's command line gives: ``-P``/``--activate-profiles`` with
    names (``!`` or ``-`` in front leaves a profile out) and ``-D``/``--define`` with properties (no value: ``true``)."""
    active, inactive, given = [], [], {}

    def take(option: str, value: str) -> None:
        if option == "-P":
            for name in filter(None, map(str.strip, value.split(","))):
                if name[0] in "!-" and len(name) > 1:
                    inactive.append(name[1:])
                else:
                    active.append(name)
        else:
            name, has_value, text = value.partition("=")
            given[name] = text if has_value else "true"

    long = {"--activate-profiles": "-P", "--define": "-D"}
    waiting = None
    for argument in arguments:
        name, has_value, value = argument.partition("=")
        if waiting:
            take(waiting, argument)
            waiting = None
        elif argument in ("-P", "-D") or argument in long:
            waiting = long.get(argument, argument)
        elif name in long and has_value:
            take(long[name], value)
        elif argument[:2] in ("-P", "-D"):
            take(argument[:2], argument[2:].removeprefix("="))
    return {"active": tuple(active), "inactive": tuple(inactive), "user_properties": given}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(place): the absolute paths of all files below ``root`` and of their folders; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("place"))
    parts = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("place")).distinct()


def _normal(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and doubled separators."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def _property_map(values: dict[str, str] | None) -> Column:
    values = values or {}
    return F.map_from_arrays(F.lit(list(values)).cast("array<string>"), F.lit(list(values.values())).cast("array<string>"))


def _over(weak: Column, strong: Column) -> Column:
    return F.map_concat(F.map_filter(weak, lambda k, v: ~F.map_contains_key(strong, k)), strong)


def read_poms(spark: SparkSession, root: str, properties: dict[str, str] | None = None, active: tuple[str, ...] = (), inactive: tuple[str, ...] = (), user_properties: dict[str, str] | None = None) -> DataFrame:
    """(path, coordinate, packaging, declared_modules, active_modules) of every ``pom.xml`` below ``root``.

    Coordinates fall back to the parent's group and version, and to ``?``.  ``properties`` are those of the system
    (``java.version``, ``os.name``, ``env.HOME`` and so on), ``user_properties`` those of the command line.  A POM's
    values are filled from, weakest first: the system's, those of local parents, its own, ``basedir``, the command
    line's.  A profile adds its modules if it is active; its conditions only see the system's and the command line's
    properties and ``basedir``.  Files are looked up among all that lies below ``root``, folders with a file in them
    included; what lies outside counts as missing.  A cycle of parents is an error.
    """
    given = _property_map(user_properties)
    outside = _property_map(properties)

    def parse(batches):
        for pdf in batches:
            yield pd.DataFrame([{"file": p, **_parse(bytes(c))} for p, c in zip(pdf["path"], pdf["content"], strict=True)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "pom.xml").load(root).select("path", "content")
    base = root.rstrip("/").removeprefix("file:") + "/"
    path = F.substring_index(F.regexp_replace("file", "^file:/*", "/"), base, -1)
    raw = step(files.mapInPandas(parse, _RAW).withColumn("path", path).drop("file"))
    parents = raw.select(F.col("path").alias("_from"), module_pom(F.concat_ws("/", F.nullif(folder(F.col("path")), F.lit("")), F.lit("pom.xml")), F.col("parent_path")).alias("_parent")).where("_parent IS NOT NULL")
    of = raw.select(F.col("path").alias("_parent"), F.col("properties").alias("_above"))
    merged = raw.select("path", "properties", F.col("path").alias("_from"), F.array("path").alias("_seen"))
    done = []
    while True:
        above = step(merged.join(parents, "_from", "left").join(of, "_parent", "left"))
        done.append(above.where("_above IS NULL").select("path", "properties"))
        merged = above.where("_above IS NOT NULL")
        if merged.isEmpty():
            break
        if not merged.where(F.array_contains("_seen", F.col("_parent"))).isEmpty():
            raise InvalidScope("local parents form a cycle")
        # a nearer property wins over one from above
        above = F.map_filter("_above", lambda k, v: ~F.map_contains_key("properties", k))
        merged = merged.select("path", F.map_concat("properties", above).alias("properties"), F.col("_parent").alias("_from"), F.array_append("_seen", F.col("_parent")).alias("_seen"))
    inherited = done[0]
    for d in done[1:]:
        inherited = inherited.union(d)
    at_root = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    home = F.concat_ws("/", F.lit(at_root), F.nullif(folder(F.col("path")), F.lit("")))
    based = F.create_map(F.lit("basedir"), home, F.lit("project.basedir"), home)
    rows = raw.drop("properties").join(inherited, "path").withColumn("_p", _over(_over(_over(outside, F.col("properties")), based), given))
    rows = step(rows.withColumn("_a", _over(outside, given)).withColumn("_home", home).drop("properties"))
    get = lambda name: F.element_at("_a", F.lit(name))
    full = lambda c: interpolated(F.col(c), F.col("_p"))
    first = lambda *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs), F.lit("?"))
    each = rows.select("path", "_a", "_home", F.posexplode("profiles").alias("_pos", "p"))
    # file conditions meet the listing in a join: one row for each that is asked
    seen = _over(F.col("_a"), F.create_map(F.lit("basedir"), F.col("_home"), F.lit("project.basedir"), F.col("_home")))
    wish = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(interpolated(F.col(f"p.{k}"), F.col("_seen")), F.lit("")).alias("file")) for k in ("exists", "missing"))))
    wishes = each.where("p.has_file").withColumn("_seen", seen).select("path", "_pos", "_home", wish).where(F.trim("file") != "")
    wishes = wishes.select("path", "_pos", "kind", _normal(F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "_home", "file"))).alias("place"))
    there = wishes.join(listing(spark, root).withColumn("_there", F.lit(True)), "place", "left").groupBy("path", "_pos").agg(F.bool_and(F.coalesce("_there", F.lit(False)) == (F.col("kind") == "exists")).alias("_files"))
    each = each.join(there, ["path", "_pos"], "left")
    asked = lambda c: interpolated(F.coalesce(F.col(c), F.lit("")), F.col("_a"))
    name = asked("p.property")
    wanted = [
        F.when(F.trim(F.coalesce("p.jdk", F.lit(""))) != "", F.coalesce(jdk_in_range(F.col("p.jdk"), F.coalesce(get("java.version"), F.lit(""))), F.lit(False))),
        F.when(F.col("p.has_os"), os_value(F.col("p.os_name"), get("os.name")) & os_value(F.col("p.os_arch"), get("os.arch")) & os_version(F.col("p.os_version"), get("os.version")) & os_family(F.col("p.os_family"), get("os.name"))),
        F.when(F.col("p.has_property"), F.coalesce(property_active(name, asked("p.value"), F.element_at("_a", F.regexp_replace(name, "^!", ""))), F.lit(False))),
        F.when(F.col("p.has_file"), F.coalesce("_files", F.lit(True))),
    ]
    forced = F.when(F.col("p.id").isin(*inactive), "INACTIVE").when(F.col("p.id").isin(*active), "ACTIVE")
    profiles = each.select(F.col("path").alias("pom"), "_pos", F.col("p.modules").alias("modules"), forced.alias("forced"), F.array_compact(F.array(*wanted)).alias("conditions"), F.col("p.by_default").alias("active_by_default"))
    added = active_profiles(profiles).groupBy(F.col("pom").alias("path")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "modules"))), lambda x: x["modules"])).alias("_all"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("active"), F.struct("_pos", "modules")))), lambda x: x["modules"])).alias("_active"),
    )
    rows = rows.join(added, "path", "left")
    none = F.array().cast("array<string>")
    modules = lambda extra: F.array_sort(F.filter(F.transform(F.concat("modules", F.coalesce(extra, none)), lambda m: interpolated(m, F.col("_p"))), lambda m: m != ""))
    coordinate = F.concat_ws(":", first(full("group_id"), full("parent_group")), first(full("artifact_id")), first(full("version"), full("parent_version")))
    return rows.select("path", coordinate.alias("coordinate"), F.coalesce(F.nullif(F.trim(full("packaging")), F.lit("")), F.lit("jar")).alias("packaging"), modules(F.col("_all")).alias("declared_modules"), modules(F.col("_active")).alias("active_modules"))
