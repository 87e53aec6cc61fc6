"""Facts of values and the order of checks against recursive brute force."""

import random

import pytest

from rippleframe.operators import dataflow

VALUES, USES = "body int, value int, kind string, type string, text string", "body int, value int, ord int, input int"


def bodies(rng, n):
    values, uses = [], []
    for body in range(n):
        for value in range(1, 8):
            kind = rng.choice(["string", "string", "class", "new", "null", "param", "none", "invoke", "cast", "pi", "phi", "phi", "phi"])
            values.append((body, value, kind, rng.choice(["A", "B", "C", None, "?"]), rng.choice(["x", "y"])))
            if kind in ("cast", "pi"):
                uses.append((body, value, 0, rng.randint(1, 8)))
            if kind == "phi":
                uses += [(body, value, i, rng.choice([-1, *range(1, 9), value - 1 or 1])) for i in range(rng.randint(0, 3))]
    return values, uses


def constant(body, value, facts, inputs, expected, seen=()):
    if value in seen:
        return None, "cyclic-definition"
    kind, _, text = facts.get((body, value), ("none", None, None))
    if kind == expected:
        return text, None
    seen = (*seen, value)
    own = inputs.get((body, value), [])
    if kind in ("cast", "pi"):
        return constant(body, own[0], facts, inputs, expected, seen)
    if kind == "phi":
        merged = None
        for i in own:
            text, why = constant(body, i, facts, inputs, expected, seen)
            if why:
                return None, "phi-input-unresolved"
            if merged is not None and merged != text:
                return None, "phi-inputs-differ"
            merged = text
        return (merged, None) if own else (None, "empty-phi")
    return None, "parameter-or-unknown-definition" if kind in ("param", "const", "null", "none", "string", "class") else f"unsupported-definition={kind}"


@pytest.mark.parametrize("expected", ["string", "class"])
def test_local_constants(spark, expected):
    values, uses = bodies(random.Random(1), 60)
    facts = {(b, v): (k, t, x) for b, v, k, t, x in values}
    inputs = {}
    for b, v, _, i in sorted(uses):
        inputs.setdefault((b, v), []).append(i)
    got = {(r["body"], r["value"]): (r["text"], r["reason"]) for r in dataflow.local_constants(spark.createDataFrame(values, VALUES), spark.createDataFrame(uses, USES), expected).collect()}
    assert got == {key: constant(*key, facts, inputs, expected) for key in facts}


def test_receiver_types_and_verdicts(spark):
    values, uses = bodies(random.Random(2), 60)
    facts = {(b, v): (k, t) for b, v, k, t, _ in values}
    inputs = {}
    for b, v, _, i in sorted(uses):
        if i >= 1:
            inputs.setdefault((b, v), []).append(i)
    up = {("A", "A"), ("B", "B"), ("C", "C"), ("B", "A")}

    def below(body, value, seen):
        return any(i == seen or below_once(body, i, seen, {value}) for i in inputs.get((body, value), []))

    def below_once(body, value, seen, done):
        if value in done:
            return False
        done.add(value)
        return any(i == seen or below_once(body, i, seen, done) for i in inputs.get((body, value), []))

    def receiver(body, value):
        kind, type_ = facts.get((body, value), ("none", None))
        if kind == "null":
            return "NO_NORMAL_TARGET", ()
        if kind == "new" and type_ is not None:
            return "EXACT", (type_,)
        if kind not in ("cast", "pi", "phi") or below(body, value, value):
            return "UNKNOWN", ()
        own = [receiver(body, i) for i in inputs.get((body, value), [])]
        if kind == "pi":
            return own[0]
        if kind == "cast":
            if type_ in (None, "?"):
                return "UNKNOWN", ()
            if own[0][0] != "EXACT":
                return own[0] if own[0][0] == "NO_NORMAL_TARGET" else ("UPPER_BOUND", (type_,))
            if "?" in own[0][1]:
                return "UNKNOWN", ()
            kept = tuple(t for t in own[0][1] if (t, type_) in up)
            return ("EXACT", kept) if kept else ("NO_NORMAL_TARGET", ())
        kinds = {k for k, _ in own}
        if "UNKNOWN" in kinds:
            return "UNKNOWN", ()
        if kinds <= {"NO_NORMAL_TARGET"}:
            return "NO_NORMAL_TARGET", ()
        return ("UNKNOWN", ()) if "UPPER_BOUND" in kinds else ("EXACT", tuple(sorted({t for _, ts in own for t in ts})))

    types = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "type string, concrete boolean")
    assignable = spark.createDataFrame(sorted(up), "sub string, super string")
    found = dataflow.receiver_types(spark.createDataFrame(values, VALUES), spark.createDataFrame(uses, USES), types, assignable)
    got = {(r["body"], r["value"]): (r["kind"], tuple(r["types"])) for r in found.collect()}
    assert got == {key: receiver(*key) for key in facts}
    assert {k for k, _ in got.values()} == {"UNKNOWN", "NO_NORMAL_TARGET", "EXACT", "UPPER_BOUND"}
    receivers = spark.createDataFrame([(0, 1, "EXACT", ["A", "B"]), (0, 2, "EXACT", ["A", "C"]), (0, 3, "UPPER_BOUND", ["A"]), (0, 4, "UPPER_BOUND", ["C"]), (0, 5, "NO_NORMAL_TARGET", []), (0, 6, "UNKNOWN", [])], "body int, value int, kind string, types array<string>")
    targets = spark.createDataFrame([("A", "f", "A.f", False), ("B", "f", "B.f", False), ("A", "g", "A.g", True), ("B", "g", "B.g", False), ("C", "f", "C.f", False)], "type string, selector string, target string, abstract boolean")
    asked = [(1, "f", "B.f"), (1, "f", "X"), (1, "g", "B.g"), (1, "g", "X"), (2, "f", "A.f"), (2, "f", "X"), (3, "f", "B.f"), (3, "f", "X"), (3, "g", "B.g"), (4, "f", "C.f"), (5, "f", "A.f"), (6, "f", "A.f"), (9, "f", "A.f")]
    sites = spark.createDataFrame([(0, *a) for a in asked], "body int, value int, selector string, candidate string")
    told = {(r["value"], r["selector"], r["candidate"]): r["verdict"] for r in dataflow.dispatch_verdicts(sites, receivers, types, targets, assignable).collect()}
    want = ["REACHES", "EXCLUDES", "REACHES", "UNKNOWN", "REACHES", "UNKNOWN", "REACHES", "EXCLUDES", "UNKNOWN", "UNKNOWN", "EXCLUDES", "UNKNOWN", "UNKNOWN"]
    assert told == dict(zip(asked, want, strict=True))


def test_factory_results_within_eight_hops(spark):
    chain = [(0, i, "pi", None, None) for i in range(2, 12)] + [(0, 20 + i, "cast", t, None) for i, t in ((1, "A"), (2, "B"), (3, "A"), (4, "I"), (5, "B"))]
    uses = [(0, i, 0, i - 1) for i in range(2, 12)] + [(0, 21, 0, 9), (0, 22, 0, 10), (0, 23, 0, 9), (0, 24, 0, 1), (0, 25, 0, 3), (0, 2, 1, 11)]
    valid = spark.createDataFrame([("A",), ("B",)], "type string")
    results = spark.createDataFrame([("c", 0, 1), ("d", 0, 2), ("c", 0, 1)], "call string, body int, value int")
    rows = dataflow.factory_types(results, spark.createDataFrame(chain, VALUES), spark.createDataFrame(uses, USES), valid).collect()
    assert {tuple(r) for r in rows} == {("c", "A", 21, 8), ("c", "B", 25, 2), ("d", "A", 21, 7), ("d", "B", 25, 1)}


CHECKS, NEEDS = "check_id string, degradable boolean, reactor boolean, passed boolean", "check_id string, ord int, depends_on string"


def test_checks_in_order(spark):
    checks = [("a", False, True, True), ("b", False, True, False), ("c", True, False, False), ("d", True, True, True), ("e", False, False, True), ("f", False, False, None), ("g", True, False, None)]
    needs = [("d", 0, "a"), ("d", 1, "b"), ("e", 0, "c"), ("f", 0, "e"), ("g", 0, "d"), ("g", 1, "b"), ("g", 2, "c")]
    rows = dataflow.check_results(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(needs, NEEDS)).collect()
    assert {tuple(r) for r in rows} == {
        ("a", "PASS", "CONTINUE", ""), ("b", "FAIL", "BLOCK_REACTOR", ""), ("c", "WARN", "DEGRADE", ""), ("d", "SKIPPED", "BLOCK_REACTOR", "b"), ("e", "PASS", "CONTINUE", ""), ("f", "FAIL", "BLOCK_COMMAND", ""), ("g", "SKIPPED", "BLOCK_COMMAND", "d,b"),
    }


@pytest.mark.parametrize(
    ("checks", "needs", "why"),
    [([("a", False, True, True)] * 2, [], "duplicate"), ([("a", False, True, True)], [("a", 0, "z")], "unknown"), ([("a", False, True, True), ("b", False, True, True)], [("a", 0, "b"), ("b", 0, "a")], "cycle")],
)
def test_checks_that_are_refused(spark, checks, needs, why):
    with pytest.raises(dataflow.InvalidChecks, match=why):
        dataflow.check_results(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(needs, NEEDS))


@pytest.mark.parametrize("limit", [4, 20_000])
def test_large_bodies_by_rounds_and_small_ones_in_tasks_agree(spark, monkeypatch, limit):
    """Some bodies are above the limit, some below; both ways give what brute force does."""
    monkeypatch.setattr(dataflow, "SMALL_BODY", limit)
    values, uses = bodies(random.Random(5), 12)
    values += [(99, 1, "string", None, "x"), (99, 2, "pi", None, None), (None, 1, "string", None, "x")]
    uses += [(99, 2, 0, 1)]
    facts = {(b, v): (k, t, x) for b, v, k, t, x in values if b is not None}
    inputs = {}
    for b, v, _, i in sorted(uses):
        inputs.setdefault((b, v), []).append(i)
    got = {(r["body"], r["value"]): (r["text"], r["reason"]) for r in dataflow.local_constants(spark.createDataFrame(values, VALUES), spark.createDataFrame(uses, USES), "string").collect()}
    assert got == {key: constant(*key, facts, inputs, "string") for key in facts}
    types = spark.createDataFrame([("A",), ("B",), ("C",)], "type string")
    fits = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "C"), ("B", "A")], "sub string, super string")
    known = lambda: {(r["body"], r["value"]): (r["kind"], tuple(r["types"])) for r in dataflow.receiver_types(spark.createDataFrame(values, VALUES), spark.createDataFrame(uses, USES), types, fits).collect()}
    found = known()
    monkeypatch.setattr(dataflow, "SMALL_BODY", 0)
    assert found == known() and len(found) == len(facts)


def test_long_chains_take_no_rounds(spark, monkeypatch):
    """What is written does not grow with the length of a chain of definitions."""
    written = []
    plain = dataflow.step
    monkeypatch.setattr(dataflow, "step", lambda df: written.append(1) or plain(df))
    values = [(1, 1, "string", None, "x"), *((1, v, "pi", None, None) for v in range(2, 31))]
    uses = [(1, v, 0, v - 1) for v in range(2, 31)]
    got = dataflow.local_constants(spark.createDataFrame(values, VALUES), spark.createDataFrame(uses, USES), "string").collect()
    assert {(r["value"], r["text"]) for r in got} == {(v, "x") for v in range(1, 31)} and len(written) <= 2
