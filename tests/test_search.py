from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphmill.functions import code as C
from graphmill.operators import ranking as K
from graphmill.operators import search as V
from graphmill.operators import triples as T
from graphmill.operators.traverse import distances
from graphmill.sources import turtle
from graphmill.streaming import events as E


def _hash(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return abs(h)


def test_hash_embedding(spark):
    words = ["user", "authentication", "x" * 40, ""]
    df = spark.createDataFrame([(words,), ([],)], "w array<string>")
    got = df.select(F.transform("w", V.hash32).alias("h"), V.hash_embedding(F.col("w")).alias("v")).collect()
    assert got[0].h == [_hash(w) for w in words]
    raw = [sum(math.sin((_hash(w) + d) * 0.1) for w in words) / len(words) for d in range(100)]
    norm = math.sqrt(sum(x * x for x in raw))
    assert np.allclose(got[0].v, [x / norm for x in raw]) and got[1].v == [0.0] * 100


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)] + [(99, None), (98, [0.0] * 8)], "id long, v array<double>")
    got = V.nearest(df, df.where("id % 10 = 0"), "id", "v", 3).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = u @ u[q]
        s[q] = -2
        assert [r.row_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == list(np.argsort(-s)[:3])


def test_fulltext_and_chunks(spark):
    df = spark.createDataFrame([(1, "The graph the GRAPH of"), (2, "graph"), (3, None), (4, "")], "id long, text string")
    assert {r.token: (r.n_docs, r.n_hits) for r in T.fulltext(df, "id", "text").collect()} == {"the": (1, 2), "graph": (2, 3)}
    long = "".join(chr(97 + i % 26) for i in range(2050))
    one = spark.createDataFrame([(long,), ("",), (None,)], "t string").select(V.chunks(F.col("t"), 1000, 100).alias("c")).collect()
    parts = [x.chunk for x in one[0].c]
    assert parts[0] + "".join(p[100:] for p in parts[1:]) == long and max(map(len, parts)) == 1000
    assert one[1].c is None and one[2].c is None


def test_budget_folds(spark):
    rows = [("g", i, t, s) for i, (t, s) in enumerate([(50, 9), (80, 8), (30, 7), (40, 6), (10, 5)])]
    df = spark.createDataFrame(rows, "g string, id long, t long, s long")
    skip = {r.id: r.taken for r in K.budget_fold(df, "g", "id", "t", "s", 100).collect()}
    assert skip == {0: 50, 2: 30, 4: 10}
    cut = {r.id: r.taken for r in K.budget_fold(df, "g", "id", "t", "s", 100, truncate=20).collect()}
    assert cut == {0: 50, 1: 50}


def test_distances(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x"), ("a", "b")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.steps for r in distances(edges, start, 5).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node: r.steps for r in distances(edges, start, 1, directed=False).collect()} == {"a": 0, "b": 1, "c": 1}


def test_declarations(spark):
    source = "class A:\n    def m(self):\n        pass\n\nasync def f():\n    return 1\n"
    df = spark.createDataFrame([("p", "python", source), ("n", "python", None)], "id string, language string, text string")
    got = [(r.line_no, r.kind, r.name) for r in C.declarations(df, "language", "text").orderBy("line_no").collect()]
    assert got == [(1, "class", "A"), (2, "method", "m"), (5, "function", "f")]


def test_turtle_round_trip(spark):
    text = '@prefix ex: <http://a.b/> .\n# remark\nex:s a ex:T ;\n  ex:p "x \\"y\\"\\n z"@en , 5.2 ;\n  ex:q <http://c.d/e.f> .\n_:b ex:p "1"^^<http://t/int> .\nex:bad ex:p'
    df = spark.createDataFrame([("f.ttl", text), ("n.ttl", None)], "path string, text string")
    rows = turtle.read(df, "path", "text").collect()
    assert len(rows) == 5 and rows[0].object == "http://a.b/T" and rows[1].lang == "en" and rows[1].object == 'x "y"\n z'
    assert [r.line_no for r in rows] == [3, 4, 4, 5, 6]
    back = turtle.read(turtle.write(turtle.read(df, "path", "text")), "path", "text").collect()
    key = lambda r: (r.subject, r.predicate, r.object, r.object_type, r.lang)
    assert Counter(map(key, back)) == Counter(map(key, rows))


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"k{i % 3}", i * 40 if i < 20 else i * 400, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, key string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.orderBy("event_id").repartition(2).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, key string, value double, ts timestamp"
    for name, make in (("debounce", lambda x, late: E.debounce(x, "key", "ts", "5 minutes", late)), ("window", lambda x, late: E.windowed_metrics(x, "key", "ts", "value", "10 minutes", late))):
        stream = make(E.read_events(spark, str(tmp_path / "in"), schema, 10), "1 hour")
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name == "window" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = set(map(tuple, spark.table(name).collect()))
        want = set(map(tuple, make(df, None).collect()))
        assert got <= want and got, name
        if name == "window":
            assert got == want
    sink = E.upsert_latest(str(tmp_path / "out"), "key", "ts")
    q = E.read_events(spark, str(tmp_path / "in"), schema, 10).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = E.read_latest(spark, str(tmp_path / "out")).collect()
    assert len(kept) == 3 and {r.key: r.event_id for r in kept} == {"k0": 39, "k1": 37, "k2": 38}
    assert E.cooldown(df, "key", "ts", 600).count() == 3 + 20  # the first of each key, and all that come 1200 s apart
