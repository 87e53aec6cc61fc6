"""Dependency scopes send no table of nodes through the driver."""

import re

from rippleframe.operators import normalize


def test_nodes_are_not_broadcast(spark, monkeypatch):
    plans = []
    plain = normalize.step
    monkeypatch.setattr(normalize, "step", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    nodes = plain(spark.createDataFrame([(m, n, n == 0, n == 2) for m in (0, 1) for n in range(4)], "module int, node long, is_root boolean, reactor boolean"))  # a file of known size, small enough to be broadcast
    edges = spark.createDataFrame([(m, 0, n) for m in (0, 1) for n in (1, 2, 3)], "module int, src long, dst long")
    rows = normalize.dependency_scopes(nodes, edges, spark.createDataFrame([(0, 3), (1, 9)], "module int, node long"))
    assert sorted(map(tuple, rows.collect())) == [(0, 1, "NO_OP", "CHANGED_PATHS", None), (0, 3, "REAL_IR", "CHANGED_PATHS", None), (1, 1, "REAL_IR", "FULL", "SEED_MISSING"), (1, 3, "REAL_IR", "FULL", "SEED_MISSING")]
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search(r"BroadcastHashJoin \[.*module#.*node#", p) for p in plans)
