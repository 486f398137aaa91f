from __future__ import annotations

import random

from graphmill.operators import hierarchy as H

SCHEMA = "child string, parent string, depth string"


def _full(spark, rows):
    links = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    return {r.node_id: r for r in H.hierarchy(links, "child", "parent").collect()}


def test_chain_tree_and_nulls(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(30)]
    full = _full(spark, [*chain, *chain[:3], ("leaf", "n3"), (None, "n1"), ("lost", None)])
    assert full["n30"].depth == 30 and full["n30"].root_id == "n0" and full["n30"].path == [f"n{i}" for i in range(31)]
    assert full["leaf"].path == ["n0", "n1", "n2", "n3", "leaf"] and "lost" not in full
    assert full["n0"].parent_id is None and full["n0"].depth == 0


def test_cycles_and_what_hangs_below(spark):
    full = _full(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s"), ("t", "s"), ("x", "r")])
    assert {n for n, r in full.items() if r.status == "cycle"} == {"a", "b", "c", "s"}
    assert {n for n, r in full.items() if r.status == "below_cycle"} == {"d", "e", "t"}
    assert full["x"].status == "tree" and full["d"].path is None


def test_several_parents(spark):
    full = _full(spark, [("k", "b"), ("k", "a"), ("a", "r"), ("b", "r"), ("r", "k"), ("z", "k")])
    assert full["k"].n_parents == 2 and full["k"].parent_id == "a"
    assert {n for n, r in full.items() if r.status == "cycle"} == {"a", "b", "k", "r"}


def test_empty(spark):
    assert _full(spark, []) == {}


def test_random_forest_against_walking(spark):
    pick = random.Random(5)
    parent = {f"v{i}": f"v{pick.randrange(max(0, i - 6), i)}" for i in range(1, 120)}
    full = _full(spark, list(parent.items()))
    for node in ["v0", *parent]:
        path = [node]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        assert full[node].path == path and full[node].depth == len(path) - 1
    pairs = spark.createDataFrame([(a, b, "") for a, b in parent.items()], SCHEMA)
    down = H.descendants(H.hierarchy(pairs, "child", "parent"))
    assert down.count() == sum(r.depth for r in full.values())


def _walked(edges):
    """Members of cycles by walking from every node."""
    down = {}
    for c, p in edges:
        down.setdefault(p, set()).add(c)
    out = set()
    for start in down:
        seen, todo = set(), list(down[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += down.get(n, ())
        if start in seen:
            out.add(start)
    return out


def test_cycles_of_random_graphs_against_walking(spark):
    pick = random.Random(11)
    for n, m in ((12, 10), (30, 34), (40, 80), (60, 62)):
        edges = [(f"v{pick.randrange(n)}", f"v{pick.randrange(n)}") for _ in range(m)]
        got = [r.member for r in H.cyclic_members(spark.createDataFrame(edges, "child string, parent string")).collect()]
        assert len(got) == len(set(got)) and set(got) == _walked(edges), edges


def test_long_chain_and_long_cycle_take_few_rounds(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(5000)] + [("n5000", "other")]
    assert H.cyclic_members(spark.createDataFrame(chain, "child string, parent string"), most_rounds=60).count() == 0
    ring = [*chain, ("n0", "n3000"), ("side", "n7")]
    assert H.cyclic_members(spark.createDataFrame(ring, "child string, parent string"), most_rounds=60).count() == 3001
