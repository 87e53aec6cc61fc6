"""Posting ranges over partition borders, and projections that put together only what is asked for."""

import random

from rippleframe.plans import catalog_reports, projections
from tests.conftest import SMALL


def test_posting_ranges(spark):
    rng = random.Random(3)
    rows = [(k, i) for k in ("a", "b", None) for i in range(60) if rng.random() < 0.8] + [("c", i) for i in range(500)]
    expected, last = [], None
    for k, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if last != (k, i - 1):
            expected.append([len(expected), k, i, 0])
        expected[-1][3] += 1
        last = (k, i)
    frame = spark.createDataFrame(rows + rows[:40], "key string, id long").repartition(7)
    found = projections.posting_ranges(frame, ["key"])
    assert sorted(map(list, found.collect())) == expected


def test_rows_alone_need_no_ranges(spark, monkeypatch):
    asked = []
    ranges = projections.posting_ranges
    monkeypatch.setattr(projections, "posting_ranges", lambda *a: asked.append(a) or ranges(*a))
    assert catalog_reports._tree(spark, SMALL)["rows"].count() and catalog_reports._affected(spark, SMALL)["paths"].count()
    assert not asked
    assert set(catalog_reports._tree(spark, SMALL)) >= {"rows", "ranges", "catalog", "dependencies", "scopes", "modules"}
