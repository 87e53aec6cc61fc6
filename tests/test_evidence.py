"""Dependency evidence: nested dependencies come back whole, and invalid documents are rejected."""

import json

import pytest

from rippleframe.sources import facts


def coordinates(name):
    return dict.fromkeys(["groupId", "type", "extension", "classifier", "version", "baseVersion"], "x") | {"artifactId": name}


def test_dependency_evidence(spark, tmp_path):
    leaf = {"coordinates": coordinates("b"), "scope": "compile", "children": []}
    occurrence = {"id": "0", "coordinates": coordinates("m"), "scope": "", "moduleRoot": True, "reactor": False}
    more = [{"id": x, "coordinates": coordinates(x), "scope": "compile", "moduleRoot": False, "reactor": False} for x in "ab"]
    edges = [{"parentId": "0", "childId": "a"}, {"parentId": "a", "childId": "b"}]
    graph = {"rootId": "0", "occurrences": [occurrence, *more], "edges": edges}
    artifacts = [{"coordinates": coordinates(x), "absolutePath": f"/{x}"} for x in "ab"]
    good = {"schemaVersion": 3, "module": coordinates("m"), "moduleDirectory": "/m", "dependencies": [{"coordinates": coordinates("a"), "scope": "compile", "children": [leaf]}],
            "occurrenceGraph": graph, "selectedReactorKeys": ["k"], "artifacts": artifacts}

    def read(change):
        (tmp_path / "e.json").write_text(json.dumps(good | change))
        return facts.read_dependency_evidence(spark, str(tmp_path / "e.json"))

    found = facts.dependency_nodes(read({})).orderBy("path").collect()
    assert [(r["path"], r["coordinates"]["artifactId"]) for r in found] == [([0], "a"), ([0, 0], "b")]
    assert read({"artifacts": [artifacts[0], {"coordinates": coordinates("b") | {"version": "x-20240101"}, "absolutePath": "/b"}]}).count() == 1  # a snapshot
    for change in (
        {"occurrenceGraph": graph | {"edges": edges[:1]}},  # unreachable
        {"module": coordinates("other")},
        {"selectedReactorKeys": ["k", "k"]},
        {"artifacts": artifacts[:1]},
        {"dependencies": []},
        {"dependencies": [leaf | {"more": 1}]},
        {"moduleDirectory": "m"},
        {"occurrenceGraph": graph | {"edges": [edges[0] | {"more": 1}, edges[1]]}},
        {"artifacts": [artifacts[0], {"coordinates": coordinates("b") | {"more": 1}, "absolutePath": "/b"}]},
    ):
        with pytest.raises(facts.InvalidDocument):
            read(change)
    for change in (
        {"dependencies": [{"coordinates": coordinates("a"), "scope": "test", "children": [leaf]}]},
        {"occurrenceGraph": graph | {"occurrences": [occurrence | {"scope": "compile"}, *more]}},
        {"occurrenceGraph": graph | {"occurrences": [occurrence | {"reactor": True}, *more]}},
        {"occurrenceGraph": graph | {"occurrences": [occurrence, more[0] | {"scope": "import"}, more[1]]}},
    ):
        with pytest.raises(facts.InvalidDocument, match="scope"):
            read(change)
    # a property twice, at the top and deep inside; a cut document
    text = json.dumps(good)
    for broken in (text.replace('"moduleDirectory": "/m"', '"moduleDirectory": "/m", "moduleDirectory": "/m"'), text.replace('"moduleRoot": false', '"moduleRoot": false, "moduleRoot": false', 1), text[:-1]):
        (tmp_path / "e.json").write_text(broken)
        with pytest.raises(facts.InvalidDocument, match="repeats a property"):
            facts.read_dependency_evidence(spark, str(tmp_path / "e.json"))
