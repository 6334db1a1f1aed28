"""Trees with cycles, and neighbourhoods of many starts, against plain loops."""

import random

import pytest

from warraq.operators import graph


def forest(seed, n=60):
    """Random parents, some negative, missing, of their own or in cycles."""
    rng = random.Random(seed)
    parent = {i: rng.choice([-1, None, 999, rng.randrange(n), rng.randrange(max(i, 1))]) for i in range(n)}
    parent[0] = 1
    parent[1] = 2
    parent[2] = 3
    parent[3] = 2  # 0 and 1 lead into a cycle
    parent[n - 1] = n - 1
    return parent


def trimmed(parent):
    """Parents without cycles: each is cut above its smallest node."""
    up = {i: p for i, p in parent.items() if p is not None and p >= 0 and p in parent}
    for start in sorted(up):
        path, at = [], start
        while at in up and at not in path:
            path.append(at)
            at = up[at]
        if at in path:
            up.pop(min(path[path.index(at) :]), None)
    return up


def climb(up, node):
    out = [node]
    while out[-1] in up:
        out.append(up[out[-1]])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ancestors_and_depths_with_cycles(spark, seed):
    parent = forest(seed)
    up = trimmed(parent)
    nodes = spark.createDataFrame([(i, p, f"t{i}") for i, p in parent.items()], "node_id long, parent_id long, title string")
    want = {(i, a, k) for i in parent for k, a in enumerate(climb(up, i))}
    assert {(r.node_id, r.ancestor_id, r.up) for r in graph.ancestors(nodes).collect()} == want
    assert {(r.node_id, r.depth) for r in graph.tree_depth(nodes).collect()} == {(i, len(climb(up, i)) - 1) for i in parent}
    crumbs = {r.node_id: r.path for r in graph.breadcrumbs(nodes).collect()}
    assert crumbs == {i: " > ".join(f"t{a}" for a in reversed(climb(up, i))) for i in parent}


def test_a_long_path_takes_few_rounds(spark):
    n = 300
    nodes = spark.createDataFrame([(i, i - 1, "") for i in range(n)], "node_id long, parent_id long, title string")
    assert {(r.node_id, r.depth) for r in graph.tree_depth(nodes).collect()} == {(i, i) for i in range(n)}
    assert graph.ancestors(nodes).count() == n * (n + 1) // 2


def test_trees_without_nodes(spark):
    none = spark.createDataFrame([], "node_id long, parent_id long, title string")
    assert graph.ancestors(none).collect() == graph.tree_depth(none).collect() == graph.breadcrumbs(none).collect() == []


def around(edges, start, hops, cap):
    seen, frontier, taken = {start}, [start], {}
    for _ in range(hops):
        if not frontier or len(seen) >= cap:
            break
        rows = sorted((e for e in edges if e[0] in frontier or e[1] in frontier), key=lambda e: (-e[2], e[0], e[1]))[: 3 * cap]
        frontier = []
        for s, t, w in rows:
            if len(seen) >= cap and (s not in seen or t not in seen):
                continue
            taken[s, t] = w
            for n in (s, t):
                if n not in seen:
                    seen.add(n)
                    frontier.append(n)
    return {(start, s, t, w) for (s, t), w in taken.items()}


@pytest.mark.parametrize("hops, cap", [(1, 4), (2, 5), (3, 12), (3, 300)])
def test_neighbourhoods_of_many_starts(spark, hops, cap):
    rng = random.Random(hops * cap)
    pairs = {(rng.choice([0, 0, 0, *range(40)]), rng.randrange(40)): rng.randrange(1, 9) for _ in range(220)}
    edges = [(s, t, w) for (s, t), w in pairs.items() if s != t]
    starts = [*range(40), 77]
    got = graph.bounded_subgraph(spark.createDataFrame(edges, "student long, teacher long, weight long"), spark.createDataFrame([(i,) for i in [*starts, 3]], "start long"), hops, cap)
    assert sorted(map(tuple, got.collect())) == sorted(r for i in starts for r in around(edges, i, hops, cap))


@pytest.mark.parametrize("hot, n", [(5, 3), (1, 2), (10_000, 4)])
def test_passages_that_share_the_most_pairs(spark, hot, n):
    """One pair is in a third of all chains, others in many, and some passages have two chains."""
    rng = random.Random(hot)
    rows, of = [], {}
    for chain in range(160):
        of[chain] = rng.randrange(110)
        people = [1, 2] if chain % 3 == 0 else [rng.choice([3, 4])]
        people += [rng.randrange(3, 8) for _ in range(rng.randrange(0, 4))]
        rows += [(chain, pos, person) for pos, person in enumerate(people)]
    pairs = {}
    for (c, pos, s), (d, _, t) in zip(rows, rows[1:]):
        if c == d and s != t:
            key = (of[c], s, t)
            pairs[key] = pairs.get(key, 0) + 1
    asked = [p for p in range(110) if p % 4 == 0]
    want = set()
    for p in asked:
        shared = {}
        for (a, s, t), k in pairs.items():
            if a == p:
                for (b, s2, t2), m in pairs.items():
                    if b != p and (s, t) == (s2, t2):
                        shared[b] = shared.get(b, 0) + k * m
        want |= {(p, q, w, i + 1) for i, (q, w) in enumerate(sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:n])}
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    got = graph.mutabaat(frame(rows, "chain_id long, pos int, narrator_id long"), frame(list(of.items()), "chain_id long, passage_id long"), frame([(p,) for p in [*asked, 0, 500]], "passage_id long"), n, hot)
    assert {(r.passage_id, r.other_id, r.shared, r["rank"]) for r in got.collect()} == want
