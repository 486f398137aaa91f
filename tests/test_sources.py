from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphmill.operators import versions as W
from graphmill.plans import language as N
from graphmill.plans.recordsql import run
from graphmill.sources import files as S


def test_discovery(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\ny = 2\n", "src/b.ts": "let a;", "node_modules/c.js": "no", "src/d.bin": "?", "package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path.rpartition("/")[2]: r for r in S.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "b.ts", "package.json"} and got["a.py"].language == "python" and got["a.py"].text == "x = 1\ny = 2\n"
    assert S.discover(spark, str(tmp_path), include=r"\.ts$").count() == 1
    deps = S.package_manifest(S.discover(spark, str(tmp_path), include="package.json"), "text").collect()
    assert {(r.name, r.scope, r.version) for r in deps} == {("a", "prod", "1"), ("b", "dev", "2")}
    assert {r.n_files for r in S.structure(S.discover(spark, str(tmp_path), include="/src/")).collect()} == {1}
    assert S.modules(S.discover(spark, str(tmp_path))).first().kind == "node"


def test_lines_requirements_and_diffs(spark):
    df = spark.createDataFrame([("p", "a==1.0\n# x\n-r o.txt\nb>=2 # y\n\nc")], "path string, t string")
    assert df.select(S.lines_between(F.col("t"), 2, 3).alias("x")).first().x == "# x\n-r o.txt"
    assert df.select(S.lines_between(F.col("t"), 6, 99).alias("x")).first().x == "c"
    assert [(r.name, r.version) for r in S.requirements(df, "t").collect()] == [("a", "1.0"), ("b", "2"), ("c", None)]
    diff = spark.createDataFrame([("A\tx.ttl",), ("R100\to.ttl\tn.ttl",), ("D\td.ttl",), ("",)], "line string")
    assert [tuple(r) for r in S.changed_files(diff, "line").collect()] == [("added", "x.ttl", None), ("renamed", "n.ttl", "o.ttl"), ("deleted", "d.ttl", None)]


def test_commits_backups_and_json(spark, tmp_path):
    rows = [("r", f"h{i}", i) for i in range(15)] + [("q", "z", 3)]
    df = spark.createDataFrame(rows, "repo string, hash string, ts long")
    assert {r.hash for r in S.commits_since(df, "repo", "h12").where("repo = 'r'").collect()} == {"h13", "h14"}
    assert S.commits_since(df, "repo", None).count() == 11
    assert S.keep_backups(df, "repo", "ts", 2).count() == 3
    S.save_json(df, str(tmp_path / "j"))
    assert S.load_json(spark, str(tmp_path / "j"), "repo string, hash string, ts long").count() == 16


def test_versions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, v string, ts int")
    new = spark.createDataFrame([(1, "a", 1), (2, "c", 1), (4, "d", 4)], "id int, v string, ts int")
    assert {r.id: r.change for r in W.diff(old, new, ["id"]).collect()} == {1: "unchanged", 2: "updated", 3: "deleted", 4: "created"}
    assert {r.change: r.n for r in W.sync_counts(new, old, ["id"]).collect()} == {"unchanged": 1, "updated": 1, "deleted": 1, "created": 1}
    assert W.apply(old, new, ["id"]).count() == 4
    pick = lambda how: {r.id: r.v for r in W.resolve(new, old, "id", how, "ts").collect()}
    assert pick("source_wins")[2] == "c" and pick("target_wins")[2] == "b" and pick("last_write_wins")[2] == "b" and pick("merge")[2] == "c" and pick("source_wins")[3] is None
    q = spark.createDataFrame([("SELECT ?s WHERE { { a } UNION { b } OPTIONAL { c } FILTER(x) }",), ("ASK { }",), ("select now()",)], "t string")
    rows = q.select(W.query_complexity(F.col("t")).alias("c"), W.cacheable(F.col("t")).alias("k")).collect()
    assert [r.c for r in rows] == ["high", "low", "low"] and [r.k for r in rows] == [True, True, False]
    jobs = spark.createDataFrame([("a", "failed"), ("a", "failed"), ("a", "failed"), ("b", "failed"), ("b", "done"), ("c", "failed"), ("d", "started")], "job string, event string")
    assert {r.job: r.state for r in W.job_states(jobs, "job").collect()} == {"a": "dropped", "b": "done", "c": "retry", "d": "running"}


def test_questions(spark):
    q = N.ask("Show the top 5 users with age greater than 30 sorted by name desc", ["Product", "User"])
    assert (q.intent, q.entity, q.filters, q.order, q.limit) == ("find", "User", [("age", ">", "30")], ("name", True), 5)
    df = spark.createDataFrame([("a", 31), ("b", 40), ("c", 10)], "name string, age int")
    assert [r.name for r in run(df, N.to_records(q)).collect()] == ["b", "a"]
    assert N.to_sparql(N.ask("How many Service are in the ontology?", ["Service"])) == 'SELECT (COUNT(?s) AS ?n) WHERE { ?s hasType "Service" }'
    assert N.ask("Which path between the modules?", []).route == "graph"
    with pytest.raises(LookupError):
        N.to_records(N.ask("Tell me a story", ["User"]))
