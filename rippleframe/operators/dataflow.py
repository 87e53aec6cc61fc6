"""Facts of values inside method bodies: constants, receiver types, factory results; and the order of checks.

A body's values are rows (body, value, kind, type, text): ``kind`` is ``string``, ``class``, ``null``, ``param``,
``const``, ``new``, ``cast``, ``pi``, ``phi``, ``none`` (no definition) or the name of another instruction; casts, pis
and phis have their inputs in (body, value, ord, input).  Facts flow from definitions to uses: what has all its inputs is
settled next, and what never gets them depends on a cycle.  Bodies know nothing of each other: those of at most
``SMALL_BODY`` rows are solved one after the other within tasks, after one shuffle; larger ones by rounds of joins over
all of them at once.  Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import _strong, strong_components
from .steps import forget, step

COMPOSED = ("cast", "pi", "phi")
#: Fixed value: how many phis and pis a result is followed through.
MAX_HOPS = 8
#: Values, inputs and pairs of types of a body that one task holds (a few MB).
SMALL_BODY = 20_000
_KEY = ["body", "value"]
_VALUE, _USE, _PAIR = range(3)


def _rounds(composed: DataFrame, inputs: DataFrame, known: DataFrame, combine) -> tuple[DataFrame, DataFrame]:
    """(facts of all that could be settled, what is still open): ``combine`` turns rows of settled values into facts.

    ``known`` (body, value, fact struct); ``composed`` (body, value, kind, type).  ``combine`` gets the composed rows with
    ``facts``, their inputs' facts in order (a composed value has a few inputs, so the list is short).
    """
    wanted = step(inputs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).join(composed, _KEY, "right").withColumn("n", F.coalesce("n", F.lit(0))))
    settled, pieces = known, [known]
    while not wanted.isEmpty():
        got = inputs.join(wanted.select(*_KEY), _KEY, "left_semi").join(settled.select("body", F.col("value").alias("input"), "fact"), ["body", "input"])
        listed = got.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("ord", "fact"))).alias("facts"))
        none = F.filter(F.array(F.struct(F.lit(0).cast(inputs.schema["ord"].dataType).alias("ord"), F.lit(None).cast(known.schema["fact"].dataType).alias("fact"))), lambda x: F.lit(False))
        ready = wanted.join(listed, _KEY, "left").withColumn("facts", F.coalesce("facts", none)).where(F.size("facts") == F.col("n"))
        new = step(combine(ready).select(*_KEY, "fact"))
        if new.isEmpty():
            break
        pieces.append(new)
        settled = reduce(DataFrame.union, pieces)
        left = step(wanted.join(new, _KEY, "left_anti"))
        forget(wanted)
        wanted = left
    return settled, wanted.select("body", "value", "kind", "type")


def _body_rows(values: DataFrame, uses: DataFrame) -> DataFrame:
    """Values and uses in one table, told apart by ``tag``; a value has its own flag, a use its place and input."""
    kinds = {f.name: f.dataType for f in uses.schema}
    values = values.withColumn("value", F.col("value").cast(values.select("value").union(uses.select("input")).schema["value"].dataType))
    flag = F.col("flag") if "flag" in values.columns else F.lit(False)
    no = lambda kind: F.lit(None).cast(kind)
    defined = values.select("body", F.lit(_VALUE).alias("tag"), "value", no(kinds["ord"]).alias("ord"), no(kinds["input"]).alias("input"), "kind", "type", "text", flag.alias("flag"))
    used = uses.select("body", F.lit(_USE), "value", "ord", "input", no("string"), no("string"), no("string"), no("boolean"))
    return defined.union(used).where("body IS NOT NULL AND value IS NOT NULL")


def _by_body(rows: DataFrame, solve: Callable[[dict, dict, set], Iterable[tuple]], result: str) -> tuple[DataFrame, DataFrame]:
    """(facts of all values of small bodies, the bodies that are larger): ``solve`` gets a body's values, value to (kind, type,
    text, flag), its inputs, value to a list of (ord, input), and its pairs of types, and gives (value, *facts).

    A task holds one body at a time; of a larger one it keeps the name alone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"body {kinds['body']}, value {kinds['value']}, {result}"
    types = to_arrow_schema(StructType.fromDDL(schema))
    limit, names = SMALL_BODY, ["body", "tag", "value", "ord", "input", "kind", "type", "text", "flag"]

    def run(batches):
        here, n, found = None, 0, []
        values: dict = {}
        inputs: dict = {}
        pairs: set = set()

        def close():
            if n > limit:
                found.append((here, *[None] * (len(types) - 1)))
            elif n:
                found.extend((here, *x) for x in solve(values, inputs, pairs))

        for batch in batches:
            for body, tag, value, ord_, input_, kind, type_, text, flag in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if body != here:
                    close()
                    here, n, values, inputs, pairs = body, 0, {}, {}, set()
                    if len(found) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), types.types, strict=True)], schema=types)
                        found = []
                n += 1
                if n > limit:
                    values, inputs, pairs = {}, {}, set()
                elif tag == _VALUE:
                    values[value] = kind, type_, text, flag
                elif tag == _USE:
                    inputs.setdefault(value, []).append((ord_, input_))
                else:
                    pairs.add((type_, text))
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), types.types, strict=True)], schema=types)

    solved = step(rows.repartition("body").sortWithinPartitions("body").mapInArrow(run, schema))
    return solved.where("value IS NOT NULL"), solved.where("value IS NULL").select("body")


def _settle(open_: Iterable, inputs: dict, facts: dict, combine: Callable) -> None:
    """Facts of the open values that get all their inputs, into ``facts``; ``combine`` gets a value and its inputs' facts."""
    left, users, ready = {}, {}, []
    for value in open_:
        waits = [i for _, i in inputs.get(value, ()) if i not in facts]
        left[value] = len(waits)
        if not waits:
            ready.append(value)
        for i in waits:
            users.setdefault(i, []).append(value)
    while ready:
        value = ready.pop()
        facts[value] = combine(value, [(o, facts[i]) for o, i in inputs.get(value, ())])
        for user in users.get(value, ()):
            left[user] -= 1
            if not left[user]:
                ready.append(user)


def _in_order(given: list[tuple]) -> list:
    """The facts by place, those of one place by themselves, nulls first: as Spark sorts them."""
    if len(given) > 1:
        nulls_first = lambda x: (x is not None, x if x is not None else 0)
        given = sorted(given, key=lambda g: (nulls_first(g[0]), *map(nulls_first, g[1])))
    return [fact for _, fact in given]


def _solve_constants(expected: str) -> Callable:
    unknown, circle = ("UNRESOLVED", None, "parameter-or-unknown-definition"), ("UNRESOLVED", None, "cyclic-definition")
    plain = ("param", "const", "null", "none", "string", "class")

    def merged(facts):
        if not facts:
            return "UNRESOLVED", None, "empty-phi"
        for status, text, _ in facts:
            if status != "RESOLVED":
                return "UNRESOLVED", None, "phi-input-unresolved"
            if text != facts[0][1]:
                return "UNRESOLVED", None, "phi-inputs-differ"
        return facts[0]

    def solve(values, inputs, pairs):
        facts = {}
        composed = []
        for value, (kind, _, text, _) in values.items():
            if kind in COMPOSED:
                composed.append(value)
            elif kind == expected:
                facts[value] = "RESOLVED", text, None
            elif kind is not None:
                facts[value] = unknown if kind in plain else ("UNRESOLVED", None, f"unsupported-definition={kind}")
        for used in inputs.values():
            for _, i in used:
                if i is not None and i not in values:
                    facts[i] = unknown

        def combine(value, given):
            listed = _in_order(given)
            return merged(listed) if values[value][0] == "phi" else listed[0] if listed else unknown

        _settle(composed, inputs, facts, combine)
        still = [v for v in composed if v not in facts]
        facts |= {v: merged(_in_order([(o, facts.get(i, circle)) for o, i in inputs[v]])) for v in still if values[v][0] == "phi"}
        rest = [v for v in still if v not in facts]
        _settle(rest, inputs, facts, combine)
        facts |= {v: circle for v in rest if v not in facts}
        return [(v, *facts[v]) for v in values if v in facts]

    return solve


def _solve_receivers(values: dict, inputs: dict, pairs: set) -> list[tuple]:
    """The flag of an allocation or a cast tells that its type is known; pairs are the assignable ones (sub, super)."""
    unknown, none = ("UNKNOWN", ()), ("NO_NORMAL_TARGET", ())
    facts, composed, known = {}, [], set()
    for value, (kind, type_, _, flag) in values.items():
        if flag:
            known.add(type_)
        if kind in COMPOSED:
            composed.append(value)
        elif kind is not None:
            facts[value] = none if kind == "null" else ("EXACT", (type_,)) if kind == "new" and type_ is not None else unknown
    own = set(composed)
    inputs = {v: [(o, i) for o, i in used if i is not None and i >= 1] for v, used in inputs.items() if v in own}
    for used in inputs.values():
        for _, i in used:
            if i not in values:
                facts[i] = unknown

    def combine(value, given):
        kind, type_, _, flag = values[value]
        listed = _in_order(given)
        if kind == "phi":
            kinds = {k for k, _ in listed}
            if "UNKNOWN" in kinds:
                return unknown
            if kinds <= {"NO_NORMAL_TARGET"}:
                return none
            return unknown if "UPPER_BOUND" in kinds else ("EXACT", tuple(sorted({t for _, types in listed for t in types})))
        fact = listed[0] if listed else unknown
        if kind == "pi" or (flag and fact == none):
            return fact
        if not flag:
            return unknown
        if fact[0] != "EXACT":
            return "UPPER_BOUND", (type_,)
        if not known.issuperset(fact[1]):
            return unknown
        kept = tuple(t for t in fact[1] if (t, type_) in pairs)
        return ("EXACT", kept) if kept else none

    _settle(composed, inputs, facts, combine)
    still = [v for v in composed if v not in facts]
    if still:
        left = set(still)
        onward: dict = {}
        for v in still:
            for _, i in inputs.get(v, ()):
                if i in left:
                    onward.setdefault(i, []).append(v)
        names = _strong(onward, still)
        members: dict = {}
        for v in still:
            members.setdefault(names[v], []).append(v)
        facts |= {v: unknown for v in still if len(members[names[v]]) > 1 or v in onward.get(v, ())}
        _settle([v for v in still if v not in facts], inputs, facts, combine)
    return [(v, facts[v][0], list(facts[v][1])) for v in values if v in facts]


def local_constants(values: DataFrame, uses: DataFrame, expected: str) -> DataFrame:
    """(body, value, status, text, reason) of every value, for constants of kind ``expected`` (``string``, ``class``).

    A cast or pi has what its input has; a phi is RESOLVED if all its inputs are, to one constant.  The reason of a phi
    that is not comes from its first input that is not resolved or differs from the first one; what depends on a cycle
    is not resolved.  Inputs without a row are unknown definitions.
    """
    if expected not in ("string", "class"):
        raise ValueError(f"unknown kind of constant: {expected}")
    found, large = _by_body(_body_rows(values, uses), _solve_constants(expected), "status string, text string, reason string")
    if large.isEmpty():
        return found
    return found.union(_constants_by_rounds(values.join(large, "body", "left_semi"), uses.join(large, "body", "left_semi"), expected))


def _constants_by_rounds(values: DataFrame, uses: DataFrame, expected: str) -> DataFrame:
    fact = lambda status, text, reason: F.struct(status.alias("status"), text.cast("string").alias("text"), reason.cast("string").alias("reason"))
    no = F.lit(None).cast("string")
    kind = F.col("kind")
    why = F.when(kind.isin("param", "const", "null", "none", "string", "class"), "parameter-or-unknown-definition").otherwise(F.concat(F.lit("unsupported-definition="), kind))
    good = kind == expected
    leaf = values.where(~kind.isin(*COMPOSED)).select(*_KEY, fact(F.when(good, "RESOLVED").otherwise("UNRESOLVED"), F.when(good, F.col("text")), F.when(~good, why)).alias("fact"))
    composed = values.where(kind.isin(*COMPOSED)).select(*_KEY, "kind", "type")
    missing = uses.select("body", F.col("input").alias("value")).distinct().join(values.select(*_KEY), _KEY, "left_anti")
    known = step(leaf.union(missing.select(*_KEY, fact(F.lit("UNRESOLVED"), no, F.lit("parameter-or-unknown-definition")).alias("fact"))))
    inputs = step(uses.join(composed.select(*_KEY), _KEY, "left_semi").select("body", "value", "ord", "input"))

    def merged(facts: Column) -> Column:
        first = F.get(facts, F.lit(0))["fact"]["text"]
        bad = F.get(F.filter(facts, lambda x: (x["fact"]["status"] != "RESOLVED") | ~x["fact"]["text"].eqNullSafe(first)), F.lit(0))["fact"]
        reason = F.when(F.size(facts) == 0, "empty-phi").when(bad["status"] != "RESOLVED", "phi-input-unresolved").when(bad["status"] == "RESOLVED", "phi-inputs-differ")
        return F.when(reason.isNull(), F.get(facts, F.lit(0))["fact"]).otherwise(fact(F.lit("UNRESOLVED"), no, reason))

    combine = lambda rows: rows.withColumn("fact", F.when(F.col("kind") == "phi", merged(F.col("facts"))).otherwise(F.coalesce(F.get("facts", F.lit(0))["fact"], fact(F.lit("UNRESOLVED"), no, F.lit("parameter-or-unknown-definition")))))
    settled, still = _rounds(composed, inputs, known, combine)
    # what is left depends on a cycle: a phi tells by its inputs, the casts and pis above repeat it, bare circles name themselves
    open_phis = still.where("kind = 'phi'").select(*_KEY)
    told = inputs.join(open_phis, _KEY, "left_semi").join(settled.select("body", F.col("value").alias("input"), "fact"), ["body", "input"], "left")
    told = told.withColumn("fact", F.coalesce("fact", fact(F.lit("UNRESOLVED"), no, F.lit("cyclic-definition"))))
    listed = told.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("ord", "fact"))).alias("facts")).select(*_KEY, merged(F.col("facts")).alias("fact"))
    settled = step(settled.union(listed))
    rest = still.where("kind <> 'phi'")
    settled, still = _rounds(rest, inputs.join(rest.select(*_KEY), _KEY, "left_semi"), settled, combine)
    settled = settled.union(still.select(*_KEY, fact(F.lit("UNRESOLVED"), no, F.lit("cyclic-definition")).alias("fact")))
    return settled.join(values.select(*_KEY), _KEY, "left_semi").select(*_KEY, "fact.*")


def receiver_types(values: DataFrame, uses: DataFrame, types: DataFrame, assignable: DataFrame) -> DataFrame:
    """(body, value, kind, types): EXACT types, an UPPER_BOUND, NO_NORMAL_TARGET or UNKNOWN for every value.

    An allocation is exact (of no type: unknown), null has no target, parameters and other definitions are unknown.  A
    cast keeps the exact types that are ``assignable`` (sub, super, itself included) to it, and bounds what is not
    exact; a phi joins exact types and is unknown with an unknown or bounded input; inputs below 1 are none.  Values on
    a cycle of definitions are unknown.  ``types`` (type) are the known ones.
    """
    known = types.select("type", F.lit(True).alias("flag")).distinct()
    typed = F.col("kind").isin("new", "cast")
    marked = values.where(typed).join(known, "type", "left").select("body", "value", "kind", "type", "text", "flag").union(values.where(~F.coalesce(typed, F.lit(False))).select("body", "value", "kind", "type", "text", F.lit(None).cast("boolean")))
    # the assignable pairs of an allocation's and a cast's type that meet in a body
    made = values.where("kind = 'new'").select("body", F.col("type").alias("sub")).distinct()
    asked = values.where("kind = 'cast'").select("body", F.col("type").alias("super")).distinct()
    pairs = made.join(asked, "body").join(assignable.select("sub", "super").distinct(), ["sub", "super"], "left_semi")
    rows = _body_rows(marked, uses)
    no = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    paired = pairs.select("body", F.lit(_PAIR).alias("tag"), no("value"), no("ord"), no("input"), no("kind"), F.col("sub"), F.col("super"), no("flag"))
    found, large = _by_body(rows.union(paired), _solve_receivers, "kind string, types array<string>")
    if large.isEmpty():
        return found
    inside = lambda table: table.join(large, "body", "left_semi")
    return found.union(_receivers_by_rounds(inside(values), inside(uses), types, assignable))


def _receivers_by_rounds(values: DataFrame, uses: DataFrame, types: DataFrame, assignable: DataFrame) -> DataFrame:
    fact = lambda kind, listed: F.struct(kind.alias("kind"), listed.cast("array<string>").alias("types"))
    none = F.array().cast("array<string>")
    unknown = fact(F.lit("UNKNOWN"), none)
    kind = F.col("kind")
    exact = (kind == "new") & F.col("type").isNotNull()
    leaf = values.where(~kind.isin(*COMPOSED)).select(*_KEY, F.when(kind == "null", fact(F.lit("NO_NORMAL_TARGET"), none)).when(exact, fact(F.lit("EXACT"), F.array("type"))).otherwise(unknown).alias("fact"))
    composed = step(values.where(kind.isin(*COMPOSED)).select(*_KEY, "kind", "type"))
    inputs = step(uses.where("input >= 1").join(composed.select(*_KEY), _KEY, "left_semi").select("body", "value", "ord", "input"))
    missing = inputs.select("body", F.col("input").alias("value")).distinct().join(values.select(*_KEY), _KEY, "left_anti")
    known = step(leaf.union(missing.select(*_KEY, unknown.alias("fact"))))
    names = types.select(F.col("type").alias("_name")).distinct()

    def combine(rows):
        given = F.col("facts")
        has = lambda k: F.exists(given, lambda x: x["fact"]["kind"] == k)
        joined = F.array_sort(F.array_distinct(F.flatten(F.transform(given, lambda x: x["fact"]["types"]))))
        phi = F.when(has("UNKNOWN"), unknown).when(F.forall(given, lambda x: x["fact"]["kind"] == "NO_NORMAL_TARGET"), fact(F.lit("NO_NORMAL_TARGET"), none)).when(has("UPPER_BOUND"), unknown).otherwise(fact(F.lit("EXACT"), joined))
        own = rows.withColumn("_in", F.coalesce(F.get(given, F.lit(0))["fact"], unknown))
        plain = own.where("kind <> 'cast'").select(*_KEY, F.when(F.col("kind") == "phi", phi).otherwise(F.col("_in")).alias("fact"))
        casts = own.where("kind = 'cast'").join(names.withColumnRenamed("_name", "type").withColumn("_bound", F.lit(True)), "type", "left")
        narrowed = casts.where("_bound AND _in.kind = 'EXACT'").select(*_KEY, "type", F.explode("_in.types").alias("_of"))
        narrowed = narrowed.join(names.withColumnRenamed("_name", "_of").withColumn("_known", F.lit(True)), "_of", "left").join(assignable.select(F.col("sub").alias("_of"), F.col("super").alias("type"), F.lit(True).alias("_fits")).distinct(), ["_of", "type"], "left")
        kept = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.col("_of"))))
        narrowed = narrowed.groupBy(*_KEY).agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("all"), kept.alias("kept"))
        exactly = F.when(~F.col("all"), unknown).when(F.size("kept") == 0, fact(F.lit("NO_NORMAL_TARGET"), none)).otherwise(fact(F.lit("EXACT"), F.col("kept")))
        wide = F.when(F.col("_bound").isNull(), unknown).when(F.col("_in.kind") == "NO_NORMAL_TARGET", F.col("_in")).otherwise(fact(F.lit("UPPER_BOUND"), F.array("type")))
        other = casts.where("_bound IS NULL OR _in.kind <> 'EXACT'").select(*_KEY, wide.alias("fact"))
        return plain.union(narrowed.select(*_KEY, exactly.alias("fact"))).union(other)

    settled, still = _rounds(composed, inputs, known, combine)
    if not still.isEmpty():
        links = inputs.join(still.select(*_KEY), _KEY, "left_semi").join(still.select("body", F.col("value").alias("input")), ["body", "input"], "left_semi")
        components = strong_components(links.select(F.col("body").alias("module"), F.col("input").alias("src"), F.col("value").alias("dst")))
        circular = components.where("cyclic").select(F.col("module").alias("body"), F.col("node").alias("value"))
        settled = step(settled.union(circular.select(*_KEY, unknown.alias("fact"))))
        rest = step(still.join(circular, _KEY, "left_anti"))
        settled, _ = _rounds(rest, inputs.join(rest.select(*_KEY), _KEY, "left_semi"), settled, combine)
    return settled.join(values.select(*_KEY), _KEY, "left_semi").select(*_KEY, "fact.*")


def dispatch_verdicts(sites: DataFrame, receivers: DataFrame, types: DataFrame, targets: DataFrame, assignable: DataFrame) -> DataFrame:
    """The rows of ``sites`` (body, value, selector, candidate) with ``verdict``: REACHES, EXCLUDES or UNKNOWN.

    ``types`` (type, concrete), ``targets`` (type, selector, target, abstract): what a selector resolves to on a type.
    Exact types must all be concrete and resolved, unless one of them reaches the candidate; of a bound all targets of
    its concrete subtypes are possible, and an abstract one, or none, leaves it open.
    """
    own = step(sites.join(receivers.select("body", "value", F.col("kind").alias("_kind"), F.col("types").alias("_types")), _KEY, "left"))
    plain = own.where(F.coalesce("_kind", F.lit("UNKNOWN")).isin("UNKNOWN", "NO_NORMAL_TARGET"))
    plain = plain.withColumn("verdict", F.when(F.col("_kind") == "NO_NORMAL_TARGET", "EXCLUDES").otherwise("UNKNOWN"))
    resolved = targets.join(types.where("concrete").select("type"), "type", "left_semi").select(F.col("type").alias("_type"), "selector", F.col("target").alias("_target"), F.col("abstract").alias("_abstract")).distinct()
    key = sites.columns
    each = own.where("_kind = 'EXACT'").select(*key, F.explode("_types").alias("_type")).join(resolved, ["_type", "selector"], "left")
    hit = F.col("_target").isNotNull() & ~F.coalesce("_abstract", F.lit(False))
    exact = each.groupBy(*key).agg(F.bool_or(hit & (F.col("_target") == F.col("candidate"))).alias("r"), F.bool_and(hit).alias("all"))
    possible = assignable.select(F.col("sub").alias("_type"), F.col("super").alias("_bound")).distinct().join(resolved, "_type").select("_bound", "selector", "_target", "_abstract").distinct()
    bounded = own.where("_kind = 'UPPER_BOUND'").select(*key, F.get("_types", F.lit(0)).alias("_bound")).join(possible, ["_bound", "selector"], "left")
    upper = bounded.groupBy(*key).agg(F.bool_or(hit & (F.col("_target") == F.col("candidate"))).alias("r"), F.bool_and(hit).alias("all"))
    told = lambda rows, reach: rows.withColumn("verdict", reach).select(*key, "verdict")
    first = F.when(F.col("r"), "REACHES").when(~F.col("all"), "UNKNOWN").otherwise("EXCLUDES")
    strict = F.when(~F.col("all"), "UNKNOWN").when(F.col("r"), "REACHES").otherwise("EXCLUDES")
    return plain.select(*key, "verdict").union(told(exact, first)).union(told(upper, strict))


def factory_types(results: DataFrame, values: DataFrame, uses: DataFrame, valid: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(call, type, cast, hops): the types that a call's result (call, body, value) is cast to.

    The result is followed through at most ``hops`` phis and pis; ``valid`` (type) are the concrete types of analysed
    code.  The witness of a type is its nearest cast, of equally near ones the smallest.
    """
    made = values.select("body", "value", "kind", "type")
    moves = step(uses.select("body", "input", "value").distinct().join(made, _KEY))
    onward = moves.where("kind IN ('phi', 'pi')").select("body", "input", F.col("value").alias("_next"))
    frontier = step(results.select("call", "body", F.col("value").alias("input")).distinct().withColumn("hops", F.lit(0)))
    levels = [frontier]
    for hop in range(1, hops + 1):
        new = frontier.join(onward, ["body", "input"]).select("call", "body", F.col("_next").alias("input")).distinct()
        frontier = step(new.join(reduce(DataFrame.union, levels), ["call", "body", "input"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    casts = moves.where("kind = 'cast'").join(valid.select("type").distinct(), "type", "left_semi").select("body", "input", "type", F.col("value").alias("cast"))
    found = reduce(DataFrame.union, levels).join(casts, ["body", "input"])
    return found.groupBy("call", "type").agg(F.min(F.struct("hops", "cast")).alias("w")).select("call", "type", F.col("w.cast").alias("cast"), F.col("w.hops").alias("hops"))


class InvalidChecks(ValueError):
    """Checks that cannot be put in order."""


def check_results(checks: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """(check_id, status, decision, blockers) of ``checks`` (check_id, degradable, reactor, passed).

    ``prerequisites`` (check_id, ord, depends_on).  A check whose prerequisite has failed or was skipped is SKIPPED and
    blocks as a failure would: its reactor, or the command.  One that does not pass (or has no outcome) is a WARN that
    degrades if it may, else a FAIL.  Layer by layer: a check is decided when all its prerequisites are.  Repeated
    checks, unknown prerequisites and cycles are errors.
    """
    if not checks.groupBy("check_id").count().where("count > 1").isEmpty():
        raise InvalidChecks("duplicate check")
    if not prerequisites.join(checks.select(F.col("check_id").alias("depends_on")), "depends_on", "left_anti").isEmpty():
        raise InvalidChecks("unknown prerequisite")
    prerequisites = step(prerequisites)
    needs = step(prerequisites.groupBy("check_id").agg(F.count(F.lit(1)).alias("n")))
    open_ = step(checks.join(needs, "check_id", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    done: list[DataFrame] = []
    block = F.when(F.col("reactor"), "BLOCK_REACTOR").otherwise("BLOCK_COMMAND")
    while not open_.isEmpty():
        if done:
            decided = reduce(DataFrame.union, done).select(F.col("check_id").alias("depends_on"), F.col("status").alias("_status"))
            got = prerequisites.join(open_.select("check_id").hint("merge"), "check_id", "left_semi").join(decided.hint("merge"), "depends_on")
            bad = F.col("_status").isin("FAIL", "SKIPPED")
            listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(bad, F.struct("ord", "depends_on")))), lambda x: x["depends_on"].cast("string")), ",")
            ready = open_.join(got.groupBy("check_id").agg(F.count(F.lit(1)).alias("got"), listed.alias("blockers")).hint("merge"), "check_id", "left")
            ready = ready.where(F.coalesce("got", F.lit(0)) == F.col("n")).withColumn("blockers", F.coalesce("blockers", F.lit("")))
        else:
            ready = open_.where("n = 0").withColumn("blockers", F.lit(""))
        passed = F.coalesce("passed", F.lit(False))
        status = F.when(F.col("blockers") != "", "SKIPPED").when(passed, "PASS").when(F.col("degradable"), "WARN").otherwise("FAIL")
        named = ready.withColumn("status", status)
        decision = F.when(F.col("status") == "PASS", "CONTINUE").when(F.col("status") == "WARN", "DEGRADE").otherwise(block)
        layer = step(named.select("check_id", "status", decision.alias("decision"), "blockers"))
        if layer.isEmpty():
            raise InvalidChecks("the checks form a cycle")
        done.append(layer)
        left = step(open_.join(layer.hint("merge"), "check_id", "left_anti"))  # no layer goes through the driver
        forget(open_)
        open_ = left
    return reduce(DataFrame.union, done) if done else open_.select("check_id", F.lit("").alias("status"), F.lit("").alias("decision"), F.lit("").alias("blockers"))
