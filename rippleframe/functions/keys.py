"""Coordinates, selectors, scopes, version ranges and derived texts as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------------------------------
SCOPES = ["compile", "runtime", "provided", "system", "test"]
DEFAULT_SCOPES = ["compile", "runtime", "provided", "system"]
TREE_SCOPES = ["compile", "runtime", "provided", "system", "test", "import"]
CHANGE_KINDS = [
    "CLASS_ADDED", "CLASS_REMOVED", "CLASS_ACCESS_NARROWED", "METHOD_ADDED", "METHOD_REMOVED", "METHOD_DESCRIPTOR_CHANGED", "METHOD_BODY_CHANGED",
    "METHOD_ACCESS_NARROWED", "FIELD_ADDED", "FIELD_REMOVED", "FIELD_DESCRIPTOR_CHANGED", "FIELD_ACCESS_NARROWED", "SERVICE_PROVIDER_REGISTRATION_REMOVED",
]
ADDED_KINDS = ["CLASS_ADDED", "METHOD_ADDED", "FIELD_ADDED"]
DEFAULT_KINDS = [k for k in CHANGE_KINDS if k not in ADDED_KINDS]
EXCLUDED_JDK = ["^javax/swing/.*", "^sun/swing/.*", "^com/sun/java/swing/.*", "^java/applet/.*", "^sun/applet/.*"]
EXCLUDED_JDK_JARS = ["jfxrt.jar", "deploy.jar", "javaws.jar", "plugin.jar"]
ORIGIN_PRIORITY = {"JDK": 0, "PROJECT": 1, "REACTOR_DEPENDENCY": 2, "DEPENDENCY": 3}
ACCESS_RANK = {"PUBLIC": 3, "PROTECTED": 2, "PACKAGE_PRIVATE": 1, "PRIVATE": 0}
CHANGE_TYPE_ORDER = {"ADDED": 0, "REMOVED": 1, "VERSION_CHANGED": 2}
COVERAGE_PRECEDENCE = {"DIFF_FAILED": 0, "BODY_BOUNDARY": 1, "INVOKEDYNAMIC": 2, "METHOD_HANDLE": 3, "SERVICE_LOADER": 4, "REFLECTION": 5, "SCOPE_VALIDATION": 6}
# ---------------------------------------------------------------------------------------------------------------------


def ranked(value: Column, order: dict[str, int], other: int) -> Column:
    return reduce(lambda rest, kv: F.when(value == kv[0], kv[1]).otherwise(rest), reversed(order.items()), F.lit(other))


def coordinate_parts(label: Column) -> Column:
    """``g:a:t:v``, ``g:a:t:v:scope`` or ``g:a:t:c:v:scope``; only six parts carry a classifier."""
    p = F.split(label, ":")
    part = lambda i: F.get(p, F.lit(i))
    six = F.size(p) == 6
    return F.when(
        F.size(p).between(4, 6),
        F.struct(part(0).alias("group_id"), part(1).alias("artifact_id"), part(2).alias("type"), F.when(six, part(4)).otherwise(part(3)).alias("version"), F.when(six, part(3)).otherwise("").alias("classifier")),
    )


def coordinate_label(group: Column, artifact: Column, kind: Column, version: Column, classifier: Column) -> Column:
    return F.concat_ws(":", group, artifact, kind, version, F.when(classifier != "", classifier))


def difference_key(group: Column, artifact: Column, kind: Column, classifier: Column) -> Column:
    return F.concat_ws(":", group, artifact, kind, F.when(classifier != "", classifier))


def tree_coordinate_parts(label: Column) -> Column:
    """with five parts, the last is a scope if it names one, else parts four and five are classifier and version."""
    p = F.split(label, ":")
    part = lambda i: F.get(p, F.lit(i))
    n = F.size(p)
    scoped = (n == 5) & part(4).isin(*TREE_SCOPES)
    version = F.when((n == 4) | scoped, part(3)).otherwise(part(4))
    classifier = F.when((n == 4) | scoped, "").otherwise(part(3))
    scope = F.when(scoped, part(4)).when(n == 6, part(5)).otherwise("")
    return F.when(n.between(4, 6), F.struct(part(0).alias("group_id"), part(1).alias("artifact_id"), part(2).alias("type"), classifier.alias("classifier"), version.alias("version"), scope.alias("scope")))


def parse_scopes(csv: str | None) -> list[str]:
    """comma-separated scopes, any case, each once; raises on an unknown or empty list."""
    if csv is None:
        return list(DEFAULT_SCOPES)
    chosen = list(dict.fromkeys(s.strip().lower() for s in csv.split(",") if s.strip()))
    if not chosen or not set(chosen) <= set(SCOPES):
        raise ValueError(f"invalid scopes: {csv}")
    return chosen


def _quoted(pattern: str, many: str, one: str) -> str:
    return "".join(many if c == "*" else one if c == "?" else re.sub(r"([^A-Za-z0-9_/ ])", r"\\\1", c) for c in pattern)


def artifact_regex(pattern: str) -> str:
    """``group:artifact`` glob; ``*`` and ``?`` cross dots, case matters, the whole name must fit."""
    if pattern.count(":") != 1 or re.search(r"\s", pattern) or pattern.startswith(":") or pattern.endswith(":"):
        raise ValueError(f"invalid artifact pattern: {pattern}")
    return f"^{_quoted(pattern, '.*', '.')}$"


def artifact_selected(name: Column, include: list[str], exclude: list[str]) -> Column:
    """no include means all; includes are alternatives; an exclude wins."""
    fits = lambda patterns: reduce(lambda a, b: a | b, (name.rlike(artifact_regex(p)) for p in dict.fromkeys(patterns)), F.lit(False))
    return (fits(include) if include else F.lit(True)) & ~fits(exclude)


def entrypoint_regex(pattern: str) -> str:
    """class path pattern; wildcards stay in a segment, a final ``**`` takes any depth below."""
    segments = pattern.split("/")
    deep = segments[-1] == "**"
    if not pattern.strip() or any(c in pattern for c in ".\\:") or "" in segments:
        raise ValueError(f"invalid entrypoint pattern: {pattern}")
    for i, s in enumerate(segments[:-1] if deep else segments):
        allowed = r"[A-Za-z0-9_$*?]+" if not deep and i == len(segments) - 1 else r"[A-Za-z0-9_*?]+"
        if "**" in s or not re.fullmatch(allowed, s):
            raise ValueError(f"invalid entrypoint pattern: {pattern}")
    plain = "/".join(_quoted(s, "[^/]*", "[^/]") for s in (segments[:-1] if deep else segments))
    if deep:
        return "^L?" + (plain + "(?:/[^/]+)+" if plain else "[^/]+(?:/[^/]+)*") + "$"
    return f"^L?{plain}$"


def entrypoint_selected(internal_name: Column, include: list[str], exclude: list[str]) -> Column:
    fits = lambda patterns: reduce(lambda a, b: a | b, (internal_name.rlike(entrypoint_regex(p)) for p in patterns), F.lit(False))
    return (fits(include) if include else F.lit(True)) & ~fits(exclude)


def jdk_excluded(internal_name: Column) -> Column:
    """F13."""
    bare = F.regexp_replace(internal_name, "^L", "")
    return reduce(lambda a, b: a | b, (bare.rlike(p) for p in EXCLUDED_JDK))


def jar_excluded(path: Column) -> Column:
    """archives of the JDK that are left out by their name."""
    return F.element_at(F.split(path, r"[/\\\\]"), -1).isin(*EXCLUDED_JDK_JARS)


def property_active(condition: Column, wanted: Column, actual: Column) -> Column:
    """F16: ``!name`` asks for absence, ``!value`` for another value, a blank value for presence; ``actual`` null is absent."""
    negated = condition.startswith("!")
    blank = F.coalesce(F.trim(wanted), F.lit("")) == ""
    return (
        F.when(negated, actual.isNull())
        .when(blank, actual.isNotNull())
        .when(wanted.startswith("!"), ~actual.eqNullSafe(F.substring(wanted, 2, 1 << 20)))
        .otherwise(actual.eqNullSafe(wanted))
    )


def version_numbers(text: Column) -> Column:
    parts = F.filter(F.split(text, "[^0-9]+"), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("bigint"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: part by part as numbers, a missing part counts as zero."""
    signs = F.zip_with(version_numbers(a), version_numbers(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0))


def jdk_in_range(condition: Column, jdk: Column) -> Column:
    """``[a,b)`` ranges with open ends; otherwise a string prefix; a leading ``!`` negates either."""
    condition = F.trim(condition)
    bare = F.trim(F.regexp_replace(condition, "^!", ""))
    is_range = bare.rlike(r"^[\[(][^,]*,[^,]*[\])]$")
    low = F.trim(F.regexp_extract(bare, r"^[\[(]([^,]*),", 1))
    high = F.trim(F.regexp_extract(bare, r",([^,]*)[\])]$", 1))
    below, above = compare_versions(jdk, low), compare_versions(jdk, high)
    inside = ((low == "") | F.when(bare.startswith("["), below >= 0).otherwise(below > 0)) & ((high == "") | F.when(bare.endswith("]"), above <= 0).otherwise(above < 0))
    fits = F.when(is_range, inside).otherwise(jdk.startswith(bare))
    return F.when(condition.startswith("!"), ~fits).otherwise(fits)


def os_value(condition: Column, actual: Column) -> Column:
    """case-blind equality, a leading ``!`` negates; a blank condition, or none, asks nothing."""
    wanted, found = F.lower(F.coalesce(condition, F.lit(""))), F.lower(F.coalesce(actual, F.lit("")))
    return F.when(F.trim(wanted) == "", True).when(wanted.startswith("!"), F.substring(wanted, 2, 1 << 20) != found).otherwise(wanted == found)


def os_version(condition: Column, actual: Column) -> Column:
    """as ``os_value``; a pattern behind ``regex:`` must fit the whole lower-cased version."""
    pattern = F.substring(condition, 7, 1 << 20)
    return F.when(F.lower(condition).startswith("regex:"), F.regexp_like(F.lower(F.coalesce(actual, F.lit(""))), F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))).otherwise(os_value(condition, actual))


# --- fixed values: what a system's lower-cased name holds if it is of a family, and what it must not hold ---------------
OS_FAMILIES = {"windows": [["windows"]], "win9x": [["windows", "95"], ["windows", "98"], ["windows", "me"], ["windows", "ce"]], "dos": [["dos"]], "mac": [["mac"]]}
NOT_UNIX = ["windows", "openvms", "os/2"]
# ---------------------------------------------------------------------------------------------------------------------


def os_family(condition: Column, name: Column) -> Column:
    """whether a system of this name is of the family; ``!`` negates, a blank family asks nothing, a family of no
    fixed meaning is looked for in the name."""
    asked, found = F.lower(F.coalesce(condition, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    family = F.when(asked.startswith("!"), F.substring(asked, 2, 1 << 20)).otherwise(asked)
    fits = F.when(family == "unix", ~reduce(lambda x, y: x | y, [found.contains(w) for w in NOT_UNIX]))
    for known, ways in OS_FAMILIES.items():
        fits = fits.when(family == known, reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [found.contains(w) for w in way]) for way in ways]))
    fits = fits.otherwise(found.contains(family))
    return F.when(F.trim(asked) == "", True).when(asked.startswith("!"), ~fits).otherwise(fits)


def search_text(*columns: Column) -> Column:
    """F20."""
    return F.lower(F.concat_ws(" ", *columns))


# --- fixed values: how a resolution is told, by what was omitted ---------------------------------------------------------
OMISSIONS = {"conflict": "Conflict mediation", "duplicate": "Duplicate mediation", "cycle": "Cycle omission"}
OTHER_OMISSION, MANAGEMENT, DIRECT, ARROW = "Maven omission", "Dependency management", "Direct selection", " → "
DETAIL = {
    "conflict": ("effective ", " → selected "), "duplicate": ("resolved ", " reused from an earlier duplicate"), "cycle": ("reported ", "; cycle omitted"), "other": ("reported ", "; omitted", "; "),
    "managed": ("requested ", " → effective "), "direct": ("requested ", " selected directly"), "selected": ("requested ", " → selected "), "reported": "reported resolved ",
}
# ---------------------------------------------------------------------------------------------------------------------


def _shown(version: Column) -> Column:
    return F.when(F.trim(version) == "", "—").otherwise(version)


def resolution_source(managed_from: Column, selected: Column, omitted: Column) -> Column:
    """where a version comes from, steps joined by an arrow."""
    managed = F.trim(managed_from) != ""
    how = reduce(lambda rest, kv: F.when(omitted == kv[0], kv[1]).otherwise(rest), OMISSIONS.items(), F.lit(OTHER_OMISSION))
    return F.concat_ws(ARROW, F.when(managed, MANAGEMENT), F.when(selected & ~managed, DIRECT), F.when(~selected, how))


def resolution_detail(requested: Column, effective: Column, chosen: Column, managed_from: Column, selected: Column, omitted: Column) -> Column:
    managed = F.trim(managed_from) != ""
    r, e, s = _shown(requested), _shown(effective), _shown(chosen)
    text = lambda kind, *parts: F.concat(F.lit(DETAIL[kind][0]), parts[0], F.lit(DETAIL[kind][1]), *parts[1:])
    left_out = (
        F.when(omitted == "conflict", text("conflict", e, s)).when(omitted == "duplicate", text("duplicate", s)).when(omitted == "cycle", text("cycle", s))
        .otherwise(F.concat(F.lit(DETAIL["other"][0]), s, F.when(F.trim(omitted) == "", DETAIL["other"][1]).otherwise(F.concat(F.lit(DETAIL["other"][2]), omitted))))
    )
    return F.concat_ws(
        "; ",
        F.when(managed, text("managed", r, e)),
        F.when(selected & ~managed & (requested == chosen), text("direct", r)),
        F.when(selected & ~managed & (requested != chosen), text("selected", r, s)),
        F.when(selected & managed & (effective != chosen), F.concat(F.lit(DETAIL["reported"]), s)),
        F.when(~selected, left_out),
    )


def member_signature(owner: Column, name: Column, descriptor: Column) -> Column:
    return F.concat(F.replace(owner, F.lit("/"), F.lit(".")), F.lit("#"), name, descriptor)


def changed_signature(owner: Column, name: Column, old: Column, new: Column) -> Column:
    """``owner#name:descriptor``, with both descriptors where they differ."""
    shown = F.when(old.isNotNull() & new.isNotNull() & (old != new), F.concat(old, F.lit(" → "), new)).otherwise(F.coalesce(new, old, F.lit("")))
    return F.concat(F.replace(owner, F.lit("/"), F.lit(".")), F.lit("#"), F.coalesce(name, F.lit("")), F.lit(":"), shown)


def maven_supported(version: Column) -> Column:
    """Whether a Maven version is at least 3.6.3 and below 4."""
    return (compare_versions(version, F.lit("3.6.3")) >= 0) & (compare_versions(version, F.lit("4")) < 0)


def mebibytes(size: Column) -> Column:
    return F.format_string("%.1f MiB", size / F.lit(1024.0 * 1024.0))


def package_of(internal_name: Column) -> Column:
    return F.when(internal_name.contains("/"), F.regexp_extract(internal_name, "^(.*)/[^/]*$", 1)).otherwise("")
