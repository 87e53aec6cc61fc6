"""Selected trees by doubling against a walk down each tree."""

import random

from rippleframe.operators import normalize

SCHEMA = "module int, node long, parent long, ord long, scope string, reactor boolean"


def walked(rows):
    out = set()
    children = {}
    for m, node, parent, _, scope, reactor in rows:
        children.setdefault((m, parent), []).append((node, scope, reactor))
    todo = [(m, node, node) for m, node, parent, *_ in rows if parent is None]
    out |= {(m, node, None) for m, node, _ in todo}
    while todo:
        m, node, place = todo.pop()
        for child, scope, reactor in children.get((m, node), []):
            if scope not in normalize.RETAINED:
                continue
            if not reactor:
                out.add((m, child, place))
            todo.append((m, child, place if reactor else child))
    return out


def test_random_trees(spark):
    rng = random.Random(6)
    rows = []
    for m in range(4):
        for n in range(70):
            parent = None if n == 0 else max(0, n - rng.randint(1, 4)) if m < 3 else n - 1
            rows.append((m, n, parent, n, rng.choice(["compile", "runtime", "compile", "provided", "system"] + ["test"] * (m == 1)), rng.random() < 0.3))
    rows += [(9, 0, None, 0, "test", True), (9, 1, 0, 1, "compile", False), (9, 2, 77, 2, "compile", False), (9, 3, 4, 3, "compile", False), (9, 4, 3, 4, "compile", False), (9, 5, 1, 5, None, False), (9, 6, 5, 6, "compile", False)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in normalize.selected_tree(frame).collect()} == walked(rows)
    assert normalize.selected_tree(frame.limit(0)).collect() == []
