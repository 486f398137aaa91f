from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphmill.operators import hierarchy as H
from graphmill.operators import relevance as V
from graphmill.operators import retrieval as R
from graphmill.operators import workflow as W
from graphmill.operators.traverse import shortest_path
from graphmill.plans.recordsql import run as record_sql
from graphmill.plans.sparql import Query, sparql

TRIPLES = "subject string, predicate string, object string, object_type string"


def test_recursive_chunks_cover_any_text(spark):
    pick = random.Random(4)
    for _ in range(150):
        text = "".join(pick.choice(["word ", "\n", "\n\n", "x" * pick.randint(1, 80), "ü🚀 ", ". "]) for _ in range(pick.randint(1, 90)))
        found, before = R.split_text(text, 60, 10), 0
        for a, b in found:
            assert a <= before < b and b - a <= 60
            before = b
        assert before == len(text)
    rows = spark.createDataFrame([(1, "a b\n\nc " * 300, ""), (2, "", ""), (3, None, "")], "k int, t string, chunk string")
    got = R.recursive_chunks(rows, "k", "t", 100, 10).collect()
    assert {r.k for r in got} == {1} and len({r.chunk_hash for r in got}) > 0 and [r.chunk_index for r in got] == list(range(got[0].n_chunks))
    with pytest.raises(ValueError):
        R.recursive_chunks(rows, "k", "t", 10, 10)


def test_thresholds_fallback_and_snippets(spark):
    assert R.threshold(V.read_question("a graph"), 500) <= 0.1 and R.threshold(V.read_question("x" * 9), 50, 0.05) == pytest.approx(0.05 * 0.8)
    rows = spark.createDataFrame([("a", 0.0), ("b", 0.05), ("c", 0.0), ("d", 0.0)], "t string, s double")
    order = (F.desc("s"), F.asc("t"))
    assert [(r.t, r.s) for r in R.at_least(rows, "s", 0.09, 3, *order).orderBy("t").collect()] == [("a", 0.1), ("b", 0.1), ("c", 0.1)]
    assert [(r.t, r.s) for r in R.at_least(rows, "s", 0.04, 3, *order).collect()] == [("b", 0.05)]
    assert R.at_least(rows.limit(0), "s", 0.04, 3, *order).count() == 0
    texts = spark.createDataFrame([("the Graph is",), ("graph",), ("none",), (None,)], "t string")
    assert [r.x for r in texts.select(R.snippet(F.col("t"), "graph").alias("x")).collect()] == ["the Graph is", "graph", None, None]


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "y"), (None, "a")], "src string, dst string")
    assert shortest_path(edges, "a", "d") == ["a", "e", "d"] and shortest_path(edges, "b", "d", directed=True) is None
    assert shortest_path(edges, "a", "a") == ["a"] and shortest_path(edges, "a", "y") is None


def test_strong_parts(spark):
    links = [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d"), ("f", "e"), ("d", "f"), ("g", "f"), ("h", "h")]
    rows = H.strong_parts(spark.createDataFrame(links, "child string, parent string")).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c"], ["d", "e", "f"]]


def test_queries_with_strange_characters_or_products_are_refused(spark):
    store = spark.createDataFrame([("a", "p", "b", "uri"), ("b", "q", "c", "uri"), ("b", "n", "10", "literal"), ("b", "n", "9", "literal"), ("b", "n", "9", "literal")], TRIPLES)
    for text in ("SELECT ?a WHERE { ?a ~p ?b }", "SELECT ?a WHERE { ?a p ?b } $", "DESCRIBE ?x"):
        with pytest.raises(ValueError):
            Query(text)
    with pytest.raises(ValueError):
        sparql(store, "SELECT ?a ?c WHERE { ?a p ?b . ?c q ?d }").count()
    with pytest.raises(ValueError):
        record_sql(store, "SELECT subject FROM t WHERE object ! 3")
    assert [tuple(r) for r in sparql(store, "SELECT ?a ?c WHERE { ?a p/q ?c }").collect()] == [("a", "c")]
    got = sparql(store, 'SELECT ?s (MIN(?n) AS ?low) (MAX(?n) AS ?high) (SUM(DISTINCT ?n) AS ?t) (GROUP_CONCAT(DISTINCT ?n; separator="|") AS ?c) WHERE { ?s n ?n } GROUP BY ?s').first()
    assert (got.low, got.high, got.t, got.c) == ("9", "10", 19.0, "10|9")


def test_workflow_steps(spark):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "k string, n int, v string")
    fresh = spark.createDataFrame([("a", 9, "y"), ("c", 8, None)], "k string, n int, v string")
    changed = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert {tuple(r) for r in W.incremental(state, fresh, changed, "k").collect()} == {("a", 9, "y"), ("c", 3, "z")}
    assert {tuple(r) for r in W.merge_module(state, fresh, "k", False).collect()} == {("a", 9, "y"), ("b", 2, None), ("c", 8, "z")}
    assert {tuple(r) for r in W.merge_module(state, fresh, "k", True).collect()} == {("a", 9, "y"), ("b", 2, None), ("c", 8, None)}
    assert W.evict_share(state, 0.2, F.asc("n")).count() == 1 and W.evict_share(state.limit(0), 0.2, F.asc("n")).count() == 0
    sized = spark.createDataFrame([(i, f"2025-01-0{1 + i % 3} 00:00:00", 10) for i in range(6)], "k int, at string, size long")
    assert W.keep_within(sized, "size", "at", "k", 0.5).count() == 3 and W.keep_within(sized.limit(0), "size", "at", "k", 0.5).count() == 0
    known = spark.createDataFrame([("r-12345678",)], "version_id string")
    new = spark.createDataFrame([("r", "1234567890"), ("r", "abcdefghij"), ("r", "abcdefghxx")], "repository_id string, commit_hash string")
    assert {r.version_id for r in W.create_versions(known, new).collect()} == {"r-abcdefgh"}


def test_timeouts_and_files(spark, tmp_path):
    from graphmill.plans.sparql import within
    from graphmill.sources import files

    assert len(within(spark.range(3), 60)) == 3
    slow = spark.range(0, 10**13, 1, 4).selectExpr("sum(id % 7)")
    with pytest.raises(TimeoutError):
        within(slow, 1.5)
    (tmp_path / "a.txt").write_text("1\n2\n3\n")
    (tmp_path / "big").write_bytes(b"x" * (files.MOST_BYTES + 1))
    assert files.read_lines(str(tmp_path), "a.txt", 2, 2) == "2\n" and files.read_lines(str(tmp_path), "a.txt") == "1\n2\n3\n"
    for bad in ("../x", "big"):
        with pytest.raises(ValueError):
            files.read_lines(str(tmp_path), bad)
    named = spark.createDataFrame([("a/package.json",), ("a/b.py",), ("c/README",), (None,)], "path string")
    assert {(r.build_tool, r.language) for r in files.project(named).collect()} >= {(None, "python")}
