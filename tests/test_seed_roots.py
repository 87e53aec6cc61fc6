"""Impact roots of several seeds against brute force over each seed's own trace."""

import random

from rippleframe.operators import graph


def brute(edges, nodes, seeds):
    facts = {n: (method, origin, entry, synthetic) for _, n, method, origin, entry, synthetic in nodes}
    links = {(a, b) for _, a, b in edges if not facts[a][3]}
    out = set()
    for seed in seeds:
        trace, queue = {seed}, [seed]
        while queue:
            n = queue.pop()
            for a, b in links:
                if b == n and a not in trace:
                    trace.add(a)
                    queue.append(a)
        inside = [(a, b) for a, b in links if a in trace and b in trace]
        ahead = {n: {n} for n in trace}
        changed = True
        while changed:
            changed = False
            for a, b in inside:
                if not ahead[b] <= ahead[a]:
                    ahead[a] |= ahead[b]
                    changed = True
        comps = {frozenset(m for m in trace if m in ahead[n] and n in ahead[m]) for n in trace}
        called = {facts[b][0] for a, b in inside if facts[b][1] == "PROJECT"}
        for comp in comps:
            own = [n for n in comp if facts[n][1] == "PROJECT"]
            if not own or any(b in comp and a not in comp for a, b in inside):
                continue
            choices = [n for n in own if facts[n][2]] or own
            root = min(choices, key=lambda n: (facts[n][0], n))
            cycle = len(comp) > 1 or any(a == b and a in comp for a, b in inside)
            if cycle or facts[root][0] not in called:
                out.add((seed, root, facts[root][0], cycle))
    return out


NODES = "module int, node long, method string, origin string, is_entrypoint boolean, synthetic boolean"


def run(spark, edges, nodes, seeds):
    rows = graph.seed_roots(spark.createDataFrame(edges, "module int, src long, dst long"), spark.createDataFrame(nodes, NODES), spark.createDataFrame([(0, s) for s in seeds], "module int, node long"))
    return sorted((r["seed"], r["root"], r["root_method"], r["cycle"]) for r in rows.collect())


def test_second_context_outside_one_trace(spark):
    # nodes 1 and 2 are one method; 2 is called by 3, but only in the trace of seed 8
    nodes = [(0, n, "m" if n in (1, 2) else f"x{n}", "PROJECT", False, False) for n in (1, 2, 3, 8, 9)] + [(0, 0, "root", "PROJECT", True, True)]
    edges = [(0, 1, 9), (0, 3, 2), (0, 2, 8), (0, 1, 8), (0, 0, 1), (0, 0, 3), (0, 0, 2)]
    assert run(spark, edges, nodes, [9, 8, 9]) == [(8, 3, "x3", False), (9, 1, "m", False)]


def test_random_graphs(spark):
    rng = random.Random(2)
    for _ in range(6):
        n = 24
        nodes = [(0, i, f"m{rng.randrange(8)}", rng.choice(["PROJECT", "PROJECT", "DEPENDENCY"]), rng.random() < 0.2, rng.random() < 0.08) for i in range(n)]
        edges = [(0, a, b) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(26)}]
        seeds = rng.sample(range(n), 7)
        assert run(spark, edges, nodes, seeds) == sorted(brute(edges, nodes, seeds))


def test_no_seed_no_root(spark):
    assert run(spark, [(0, 1, 2)], [(0, 1, "a", "PROJECT", False, False), (0, 2, "b", "PROJECT", False, False)], []) == []


def test_reached_carries_nodes_only(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(30)] + [(0, 30, 0), (1, 0, 5)], "module int, src long, dst long")
    seeds = spark.createDataFrame([(0, 3), (0, 4), (1, 5)], "module int, node long")
    assert sorted(map(tuple, graph.reached(edges, seeds, ("module",)).collect())) == [(0, i) for i in range(31)] + [(1, 5)]
