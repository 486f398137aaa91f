from __future__ import annotations

import itertools
import random

import pytest

from graphmill.operators import triples as T
from graphmill.plans.recordsql import run
from graphmill.plans.sparql import sparql

SCHEMA = "subject string, predicate string, object string, object_type string"
ROWS = [("module:A", "hasType", "Service", "literal"), ("module:A", "dependsOn", "module:B", "uri"), ("module:B", "hasType", "Repository", "literal"), ("module:C", "hasType", "Service", "literal")]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_patterns(store):
    assert T.match(store, subject="module:A").count() == 2
    assert T.match(store, predicate="hasType").count() == 3
    assert T.match(store, predicate="hasType", obj="Service").count() == 2
    assert T.match(store, limit=2).count() == 2
    assert T.match(store, subject="").count() == 0
    assert {r[0] for r in T.terms(store, "subject", predicate="hasType", obj="Service").collect()} == {"module:A", "module:C"}
    assert {r[0] for r in T.terms(store, "predicate", subject="module:A").collect()} == {"hasType", "dependsOn"}


def test_mutation(spark, store):
    new = spark.createDataFrame([ROWS[0], ("x", "p", "1", "literal"), ("x", "p", "1", "literal"), ("x", "p", "1", "uri")], SCHEMA)
    assert T.insert(store, new).count() == 2
    assert T.remove(store, subject="module:A").count() == 2
    assert T.exists(store, "module:A", "hasType", "Service").first().found and not T.exists(store, "nope").first().found


def test_join_on_shared_variables(store):
    rows = sparql(store, "SELECT ?m ?d ?t WHERE { ?m dependsOn ?d . ?d hasType ?t }").collect()
    assert [tuple(r) for r in rows] == [("module:A", "module:B", "Repository")]


def test_sparql_forms(store):
    assert sparql(store, 'PREFIX m: <module:> ASK { m:A hasType "Service" }').first().answer
    assert not sparql(store, 'ASK { ?x hasType "Nothing" }').first().answer
    made = sparql(store, "CONSTRUCT { ?d usedBy ?m } WHERE { ?m dependsOn ?d }").collect()
    assert [tuple(r) for r in made] == [("module:B", "usedBy", "module:A")]
    got = sparql(store, 'SELECT ?m ?d WHERE { ?m hasType ?t . OPTIONAL { ?m dependsOn ?d } FILTER(!BOUND(?d) || ?t = "Service") } ORDER BY ?m').collect()
    assert [(r.m, r.d) for r in got] == [("module:A", "module:B"), ("module:B", None), ("module:C", None)]
    assert sparql(store, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }").first().n == 4
    assert sparql(store, "SELECT ?s WHERE { ?s <http://a.b/c.d> ?o }").count() == 0
    for bad in ("", "SELECT ?s WHERE { ?s ?p ?o", "DROP ?s { }"):
        with pytest.raises(ValueError):
            sparql(store, bad)


def test_random_patterns_against_brute_force(spark):
    pick = random.Random(3)
    rows = [(pick.choice("abc"), pick.choice("pq"), pick.choice("abcd"), "uri") for _ in range(40)]
    rows = sorted(set(rows))
    store = spark.createDataFrame(rows, SCHEMA)
    for _ in range(6):
        patterns = [(pick.choice(["?x", "?y", "a"]), pick.choice("pq"), pick.choice(["?y", "?z", "b"])) for _ in range(2)]
        names = sorted({t[1:] for p in patterns for t in p if t[0] == "?"})
        if not names or not set(patterns[0]) & set(patterns[1]) & {"?x", "?y", "?z"}:
            continue
        text = f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {' . '.join(' '.join(p) for p in patterns)} }}"
        expected = []
        for pair in itertools.product(rows, repeat=2):
            env: dict[str, str] = {}
            good = all(
                (env.setdefault(t[1:], v) == v if t[0] == "?" else t == v) for p, r in zip(patterns, pair, strict=True) for t, v in zip(p, (r[0], r[1], r[2]), strict=True)
            )
            if good:
                expected.append(tuple(env[n] for n in names))
        assert sorted(tuple(r) for r in sparql(store, text).collect()) == sorted(expected)


def test_records(spark):
    df = spark.createDataFrame([(1, "Alpha", 5), (2, "beta", None), (3, "gamma", 9)], "id int, name string, n int")
    assert [r.id for r in run(df, "SELECT id FROM t WHERE n <= 9 AND NOT name contains 'GAM' ORDER BY id").collect()] == [1]
    assert [r.id for r in run(df, "SELECT * WHERE (n > 6 OR name = 'beta') ORDER BY name DESC, id").collect()] == [3, 2]
    assert run(df, "SELECT id FROM t LIMIT 0").count() == 0
    assert run(df, "GET $k", {"k": 2}).first().name == "beta"
    assert run(df, "SELECT id FROM t WHERE n = null").first().id == 2
    assert run(df, "AGGREGATE n sum").first().value == 14.0 and run(df.limit(0), "AGGREGATE n avg").first().value is None
    with pytest.raises(ValueError):
        run(df, "SELECT id FROM t LIMIT -1")
