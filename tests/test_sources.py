"""Readers of classes, archives, services and model catalogues on small files."""

import hashlib
import zipfile

import pytest

from rippleframe.sources import facts


def test_classes_in_order(spark, tmp_path):
    for name in ("b/B.class", "a/A.class", "a/module-info.class", "a/readme.txt", "A$1.class"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    rows = facts.read_classes(spark, str(tmp_path)).collect()
    assert [(r["binary_name"], r["digest"]) for r in rows] == [(n[:-6], hashlib.sha256(n.encode()).hexdigest()) for n in ("A$1.class", "a/A.class", "b/B.class")]


def test_archives_of_several_releases(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.jar", "w") as z:
        for name in ("a/A.class", "META-INF/versions/9/a/A.class", "META-INF/versions/17/a/A.class", "META-INF/versions/11/a/New.class", "module-info.class", "a/text.txt"):
            z.writestr(name, name)
    of = lambda major: {r["binary_name"]: r["entry_name"] for r in facts.read_jar_entries(spark, str(tmp_path), major).collect()}
    assert of(None) == {"a/A": "a/A.class"}
    assert of(11) == {"a/A": "META-INF/versions/9/a/A.class", "a/New": "META-INF/versions/11/a/New.class"}
    assert of(21)["a/A"] == "META-INF/versions/17/a/A.class"


def test_services_and_invalid_names(spark, tmp_path):
    (tmp_path / "p.Service").write_text("# comment\n\n p.Impl # why\np.Impl\np.Other$In\n1bad\nx..y\n")
    found, issues = facts.read_services(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("p.Service", "p.Impl"), ("p.Service", "p.Other$In")]
    assert sorted(r["provider"] for r in issues.collect()) == ["1bad", "x..y"]


def test_model_catalog(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# head\nj/List\tadd\t(Lj/O;)Z\tfalse\tSTORE\t1\tELEMENT\t-\t-\nj/F\tmap\t()V\ttrue\tCALL\t-\t-\ta:1,b:2\tRESULT\n")
    rows = sorted(facts.read_model_catalog(spark, str(tmp_path)).collect(), key=lambda r: r["name"])
    assert (rows[0]["data_arg"], rows[0]["state_slot"], rows[0]["callbacks"], rows[0]["result_slot"], rows[0]["is_static"]) == ("1", "ELEMENT", [], None, False)
    assert (rows[1]["data_arg"], rows[1]["callbacks"], rows[1]["result_slot"]) == (None, ["a:1", "b:2"], "RESULT")
    (tmp_path / "m.tsv").write_text("j/F\tmap\t()V\tmaybe\tCALL\t-\t-\t-\t-\n")
    with pytest.raises(Exception, match="MALFORMED|maybe"):
        facts.read_model_catalog(spark, str(tmp_path)).collect()
