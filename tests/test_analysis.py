from __future__ import annotations

from graphmill.functions import code as C
from graphmill.operators import relevance as V
from graphmill.operators.hierarchy import cyclic_members


def test_calls_and_ast(spark):
    df = spark.createDataFrame([("a", "if (x) {\n  foo(1); y.bar(z(2));\n}\nq = new Thing(3)\n"), ("b", None)], "id string, text string")
    got = [(r.line_no, r.receiver, r.name) for r in C.calls(df, "text").orderBy("line_no", "name").collect()]
    assert got == [(2, "y", "bar"), (2, None, "foo"), (2, None, "z"), (4, "new", "Thing")]
    py = spark.createDataFrame([("p", "import os\nfrom . import x\nclass A:\n    async def f(self):\n        def g(): pass\n"), ("q", "def broken("), ("r", None)], "id string, text string")
    rows = {(r.kind, r.name, r.line_no, r.parent, r.is_async) for r in C.python_ast(py, "text").collect()}
    assert rows == {("import", "os", 1, None, False), ("import", ".", 2, None, False), ("class", "A", 3, None, False), ("method", "f", 4, "A", True), ("function", "g", 5, "f", False)}


def test_semantic_search(spark):
    rows = [("module:UserAuth", "hasType", "Service"), ("module:UserAuth", "provides", "login"), ("module:TokenManager", "hasType", "Service"), ("module:TokenManager", "provides", "tokens"), ("module:Database", "hasType", "Repository"), ("module:Database", "provides", "storage")]
    store = spark.createDataFrame(rows, "subject string, predicate string, object string")
    q = V.read_question("user authentication login")
    assert dict(q.terms)["authentication"] == 1.43 and dict(q.terms)["user"] == 1.3
    got = V.semantic_search(store, q, 5).collect()
    assert got[0].subject == "module:UserAuth" and all(0 < r.score <= 1 for r in got) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert abs(sum(x * x for x in V.question_vector(q)) - 1) < 1e-9
    assert V.semantic_search(store, V.read_question(""), 5).count() == 0
    assert store.limit(1).select(V.sentence().alias("s")).first().s == "UserAuth is a Service"


def test_cycles_of_any_graph(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a"), ("e", "y"), ("s", "s")]
    df = spark.createDataFrame(edges, "parent string, child string")
    assert {r.member for r in cyclic_members(df).collect()} == {"a", "b", "c", "d", "e", "s"}
