"""Readers of dependency evidence, dependency texts, class files, service registrations and model catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import DEFAULT_SCOPES, tree_coordinate_parts
from ..operators.graph import validate_occurrence_graph
from ..operators.steps import step

COORDINATES = "struct<groupId:string,artifactId:string,type:string,extension:string,classifier:string,version:string,baseVersion:string>"
EVIDENCE_SCHEMA = f"""schemaVersion int, module {COORDINATES}, moduleDirectory string, dependencies array<string>,
 occurrenceGraph struct<rootId:string,occurrences:array<struct<id:string,coordinates:{COORDINATES},scope:string,moduleRoot:boolean,reactor:boolean>>,edges:array<struct<parentId:string,childId:string>>>,
 selectedReactorKeys array<string>, artifacts array<struct<coordinates:{COORDINATES},absolutePath:string>>"""
CLASSPATH_SCHEMA = f"""schemaVersion int, javaMajor int, module {COORDINATES}, moduleDirectory string, entries array<struct<`order`:int,origin:string,coordinates:{COORDINATES},scope:string,absolutePath:string>>, issues array<string>"""
#: The properties a document of each kind may have.
EVIDENCE_PROPERTIES = {"schemaVersion", "module", "moduleDirectory", "dependencies", "occurrenceGraph", "selectedReactorKeys", "artifacts"}
CLASSPATH_PROPERTIES = {"schemaVersion", "javaMajor", "module", "moduleDirectory", "entries", "issues"}
COORDINATE_PROPERTIES = sorted(["groupId", "artifactId", "type", "extension", "classifier", "version", "baseVersion"])
RETAINED_SCOPES = ["compile", "runtime", "provided", "system"]
NESTED_PROPERTIES = {"$.occurrenceGraph.occurrences": ["coordinates", "id", "moduleRoot", "reactor", "scope"], "$.occurrenceGraph.edges": ["childId", "parentId"], "$.artifacts": ["absolutePath", "coordinates"]}


def _kept_scope(scope: Column) -> Column:
    return F.coalesce(F.lower(F.trim(scope)).isin(*RETAINED_SCOPES), F.lit(False))


class InvalidDocument(ValueError):
    """A document that the strict readers reject."""


def _strict_json(spark: SparkSession, path: str, schema: str, properties: set[str], version: int) -> DataFrame:
    """One row for each document; unknown or missing properties and other schema versions stop the read."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    # the variant parser refuses an object that repeats a property, at any depth
    unread = raw.where(F.try_parse_json("value").isNull()).select("file").limit(1).collect()
    if unread:
        raise InvalidDocument(f"{unread[0]['file']}: not a JSON document, or one that repeats a property")
    bad = raw.select("file", F.array_sort(F.json_object_keys("value")).alias("k")).where(F.col("k").isNull() | (F.col("k") != F.lit(sorted(properties)))).limit(1).collect()
    if bad:
        raise InvalidDocument(f"{bad[0]['file']}: properties {bad[0]['k']}")
    rows = raw.select("file", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("file", "d.*")
    if not rows.where(f"schemaVersion IS DISTINCT FROM {version}").isEmpty():
        raise InvalidDocument(f"schema version {version} is expected")
    return rows


def _artifact(coordinates) -> Column:
    """What makes two coordinates the same artifact: neither the extension nor a snapshot's own version."""
    return F.struct(*(coordinates[f].alias(f) for f in ("groupId", "artifactId", "type", "baseVersion", "classifier")))


def _unknown_nested(spark: SparkSession, path: str) -> DataFrame:
    """The objects inside the documents whose properties are not the known ones."""
    raw = spark.read.text(path, wholetext=True)

    def wrong(df, text, known):
        keys = F.array_sort(F.json_object_keys(text))
        return df.where(keys.isNull() | (keys != F.lit(known))).select(F.lit(1))

    out = wrong(raw, F.get_json_object("value", "$.module"), COORDINATE_PROPERTIES).union(wrong(raw, F.get_json_object("value", "$.occurrenceGraph"), ["edges", "occurrences", "rootId"]))
    for place, known in NESTED_PROPERTIES.items():
        each = raw.select(F.explode(F.from_json(F.get_json_object("value", place), "array<string>")).alias("text"))
        out = out.union(wrong(each, F.col("text"), known))
        if "coordinates" in known:
            out = out.union(wrong(each, F.get_json_object("text", "$.coordinates"), COORDINATE_PROPERTIES))
    return out


def dependency_nodes(evidence: DataFrame) -> DataFrame:
    """(file, path, coordinates, scope): the nodes of the nested dependencies to any depth; ``path`` has the positions from the top."""
    node = f"coordinates {COORDINATES}, scope string, children array<string>"
    level = evidence.select("file", F.array().cast("array<int>").alias("above"), F.posexplode("dependencies").alias("pos", "text"))
    found = None
    while True:
        parsed = [F.array_sort(F.json_object_keys("text")).alias("k"), F.array_sort(F.json_object_keys(F.get_json_object("text", "$.coordinates"))).alias("c"), F.from_json("text", node, {"mode": "FAILFAST"}).alias("n")]
        level = step(level.select("file", F.concat("above", F.array("pos")).alias("path"), *parsed))
        if found is not None and level.isEmpty():
            return found
        if not level.where(F.col("k").isNull() | (F.col("k") != F.lit(["children", "coordinates", "scope"])) | F.col("c").isNull() | (F.col("c") != F.lit(COORDINATE_PROPERTIES)) | F.col("n.scope").isNull() | F.col("n.children").isNull()).isEmpty():
            raise InvalidDocument("a dependency has unknown or missing properties")
        if not level.where(~_kept_scope(F.col("n.scope"))).isEmpty():
            raise InvalidDocument("a dependency's scope is not retained")
        rows = level.select("file", "path", "n.coordinates", "n.scope")
        found = rows if found is None else found.union(rows)
        level = level.select("file", F.col("path").alias("above"), F.posexplode("n.children").alias("pos", "text"))


def read_dependency_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Schema 3 documents; ``dependencies`` holds the nested trees as JSON texts (see ``dependency_nodes``).

    Paths must be absolute, the occurrence graph valid and its root the module, reactor keys distinct, and the artifacts
    of the dependency trees exactly those that are bound, each once.  Scopes are retained ones; the module root has none
    and is no reactor's.  No object may repeat a property.
    """
    rows = _strict_json(spark, path, EVIDENCE_SCHEMA, EVIDENCE_PROPERTIES, 3)
    required = ["module", "moduleDirectory", "dependencies", "occurrenceGraph.rootId", "occurrenceGraph.occurrences", "occurrenceGraph.edges", "selectedReactorKeys", "artifacts"]
    bound = rows.select("file", F.explode("artifacts").alias("a")).select("file", "a.*")
    graph = rows.select("file", "module", "occurrenceGraph.*")
    occurrences = graph.select(F.col("file").alias("module"), F.explode("occurrences").alias("o"))
    nodes = occurrences.select("module", F.col("o.id").alias("node"), F.col("o.moduleRoot").alias("is_root"))
    edges = graph.select(F.col("file").alias("module"), F.explode("edges").alias("e")).select("module", F.col("e.parentId").alias("src"), F.col("e.childId").alias("dst"))
    root = F.exists("occurrences", lambda o: o["moduleRoot"] & (o["id"] == F.col("rootId")) & (_artifact(o["coordinates"]) == _artifact(F.col("module"))))
    selected, kept = (df.select("file", _artifact(F.col("coordinates")).alias("coordinates")) for df in (dependency_nodes(rows), bound))
    for wrong, why in [
        (rows.where(" OR ".join(f"{c} IS NULL" for c in required)), "a required property is null"),
        (_unknown_nested(spark, path), "an inner object has unknown or missing properties"),
        (rows.where("NOT startswith(moduleDirectory, '/')"), "the module directory is not absolute"),
        (bound.where("NOT coalesce(startswith(absolutePath, '/'), false)"), "an artifact path is not absolute"),
        (kept.groupBy("file", "coordinates").count().where("count > 1"), "an artifact is bound twice"),
        (nodes.where("node IS NULL OR is_root IS NULL"), "an occurrence is incomplete"),
        (nodes.groupBy("module", "node").count().where("count > 1"), "an occurrence id is repeated"),
        (occurrences.where("o.moduleRoot AND (o.reactor OR o.scope <> '')"), "the module root's scope must be empty and not of a reactor"),
        (occurrences.where(~F.col("o.moduleRoot") & ~_kept_scope(F.col("o.scope"))), "an occurrence's scope is not retained"),
        (graph.where(~F.coalesce(root, F.lit(False))), "the occurrence root is not the module"),
        (validate_occurrence_graph(nodes, edges).where("problem IS NOT NULL"), "the occurrence graph is not valid"),
        (rows.where("size(array_distinct(selectedReactorKeys)) < size(selectedReactorKeys)"), "a reactor key is repeated"),
        (selected.join(kept, ["file", "coordinates"], "left_anti"), "a selected dependency is not bound"),
        (kept.join(selected, ["file", "coordinates"], "left_anti"), "a bound artifact is not selected"),
    ]:
        if not wrong.isEmpty():
            raise InvalidDocument(why)
    return rows


def read_classpath_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Schema 1 entries; orders run from 0 without a gap, origins are known, project entries have no scope."""
    rows = _strict_json(spark, path, CLASSPATH_SCHEMA, CLASSPATH_PROPERTIES, 1)
    entries = rows.select("file", "javaMajor", "module", F.posexplode("entries").alias("pos", "e")).select("file", "javaMajor", "module", "pos", "e.*")
    wrong = (F.col("pos") != F.col("order")) | ~F.col("origin").isin("PROJECT", "REACTOR_DEPENDENCY", "DEPENDENCY") | ((F.col("origin") == "PROJECT") & (F.coalesce("scope", F.lit("")) != ""))
    if not entries.where(F.coalesce(wrong, F.lit(True))).isEmpty():
        raise InvalidDocument("a classpath entry is out of order or of unknown origin")
    return entries.drop("pos")


def parse_dependency_text(lines: DataFrame, scopes: list[str] = DEFAULT_SCOPES) -> DataFrame:
    """(file, line_no, line) to occurrences with depth, parts, annotations and the path of coordinates from the root.

    A line's parent is the last line before it that is one level higher, found within that level's lines alone; paths
    grow from the top, each line joined to its parent once.  Scopes are filtered after paths are known.
    """
    body = F.regexp_replace("line", r"^\[INFO\] ", "")
    indent = F.regexp_extract(body, r"^((?:[|+\\ ][ \-] )*)", 1)
    text = F.substr(body, F.length(indent) + 1)
    coordinate = F.regexp_extract(text, r"^\(?([^ ()]+:[^ ()]+)", 1)
    rows = lines.withColumns({"_depth": (F.length(indent) / 3).cast("int"), "_coordinate": coordinate, "_notes": F.regexp_extract(text, r"\((?:version|scope|omitted|[^()]*optional)[^()]*\)|\(.*\)", 0)}).where(F.col("_coordinate") != "")
    rows = step(rows)
    places = rows.select("file", "line_no", F.col("_depth").alias("_level"), F.col("line_no").alias("_at")).union(rows.where("_depth > 0").select("file", "line_no", F.col("_depth") - 1, F.lit(None).cast(rows.schema["line_no"].dataType)))
    so_far = Window.partitionBy("file", "_level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    parents = places.withColumn("_parent", F.last("_at", ignorenulls=True).over(so_far)).where("_at IS NULL").select("file", "line_no", "_parent")
    placed = step(rows.select("file", "line_no", "_depth", "_coordinate").join(parents, ["file", "line_no"], "left"))
    level = step(placed.where("_depth = 0").select("file", "line_no", F.array("_coordinate").alias("path")))
    levels = [level]
    for depth in range(1, (placed.agg(F.max("_depth")).first()[0] or 0) + 1):
        above = level.select("file", F.col("line_no").alias("_parent"), F.col("path").alias("_above"))
        nothing = F.array_repeat(F.lit(None).cast("string"), depth)
        own = placed.where(F.col("_depth") == depth).join(above, ["file", "_parent"], "left")
        level = step(own.select("file", "line_no", F.array_append(F.coalesce("_above", nothing), F.col("_coordinate")).alias("path")))
        levels.append(level)
    rows = rows.join(reduce(DataFrame.union, levels), ["file", "line_no"])
    note = lambda p: F.regexp_extract(F.col("_notes"), p, 1)
    out = rows.withColumn("_p", tree_coordinate_parts(F.col("_coordinate")))
    reason = F.when(note(r"omitted for (conflict)") != "", "conflict").when(note(r"omitted for (duplicate)") != "", "duplicate").when(note(r"omitted for (cycle)") != "", "cycle").otherwise("")
    out = out.select(
        "file", "line_no", F.col("_depth").alias("depth"), "_p.*", note(r"version managed from ([^;) ]+)").alias("managed_from_version"), note(r"scope managed from ([^;) ]+)").alias("managed_from_scope"),
        reason.alias("omitted_reason"), note(r"omitted for conflict with ([^;) ]+)").alias("conflict_version"), F.when(F.col("_notes").contains("optional"), True).alias("optional"), "path",
    )
    return out.where((F.col("depth") == 0) | F.col("scope").isin(*scopes))


def read_services(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registrations (service, provider) of ``META-INF/services`` files, and the issues of invalid names."""
    name = r"^[\p{L}_$][\p{L}\p{N}_$]*(\.[\p{L}_$][\p{L}\p{N}_$]*)*$"
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("service"), F.trim(F.regexp_replace("value", "#.*$", "")).alias("provider")).where("provider <> ''")
    valid = F.col("service").rlike(name) & F.col("provider").rlike(name)
    return rows.where(valid).distinct(), rows.where(~valid).select("service", "provider", F.lit("invalid name").alias("issue"))


def read_model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated model entries; ``-`` is none; callbacks are a list."""
    schema = "owner string, name string, descriptor string, is_static boolean, template string, data_arg string, state_slot string, callbacks string, result_slot string"
    rows = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)
    none = lambda c: F.when(F.col(c) != "-", F.col(c)).alias(c)
    return rows.select("owner", "name", "descriptor", "is_static", "template", none("data_arg"), none("state_slot"), F.when(F.col("callbacks") == "-", F.array()).otherwise(F.split("callbacks", ",")).alias("callbacks"), none("result_slot"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class files below a directory (binary_name, path, digest, content) in the order of their paths, without module descriptors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.class").load(path)
    below = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), path.rstrip("/").removeprefix("file:") + "/", -1)
    named = files.withColumn("binary_name", F.regexp_replace(below, r"\.class$", ""))
    return named.where(~F.col("binary_name").rlike("(^|/)module-info$")).select("binary_name", "path", F.sha2("content", 256).alias("digest"), "content").orderBy("path")


def read_jar_entries(spark: SparkSession, path: str, java_major: int | None = None) -> DataFrame:
    """Class entries (jar, binary_name, entry_name, digest) of archives; for a Java version, of multi-release entries the newest visible."""

    def entries(batches):
        import hashlib
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for jar, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".class") and not n.endswith("module-info.class")):
                        m = re.match(r"META-INF/versions/(\d+)/(.*)", name)
                        release, base = (int(m[1]), m[2]) if m else (0, name)
                        if release > (java_major or 0):
                            continue
                        rows.append((jar, base[:-6], name, release, hashlib.sha256(z.read(name)).hexdigest()))
            yield pd.DataFrame(rows, columns=["jar", "binary_name", "entry_name", "release", "digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jar").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInPandas(entries, "jar string, binary_name string, entry_name string, release int, digest string")
    newest = F.max_by(F.struct("entry_name", "digest"), "release")
    return found.groupBy("jar", "binary_name").agg(newest["entry_name"].alias("entry_name"), newest["digest"].alias("digest"))


def active_profiles(profiles: DataFrame) -> DataFrame:
    """profiles (pom, id, forced, conditions, active_by_default) with ``active``.

    ``forced`` is ACTIVE, INACTIVE or null; ``conditions`` are the outcomes of those that are there.  A default profile
    is active only while no other profile of its POM is.
    """
    own = F.when(F.col("forced") == "INACTIVE", False).when(F.col("forced") == "ACTIVE", True).otherwise((F.size("conditions") > 0) & F.forall("conditions", lambda c: c))
    marked = profiles.withColumn("_own", own)
    others = F.max(F.col("_own").cast("int")).over(Window.partitionBy("pom"))
    default = F.col("active_by_default") & (others == 0) & ~F.col("forced").eqNullSafe("INACTIVE")
    return marked.withColumn("active", F.col("_own") | default).drop("_own")
