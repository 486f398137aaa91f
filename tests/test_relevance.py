from __future__ import annotations

import re

from graphmill.operators import relevance as V

PARTS = ["", "customer:7", "module:UserAuth", "HTTPServer2Login", "aBcDeF x1Y2z", "user_name", "To\u212aen", "İstanbul login", "straßeUser", "nation-5/5#5", "Customer Segment", "--", "regionRegion region", "tokenAPI", "hasType", "dependsOn"]
QUESTIONS = ["customer segment building region", "user authentication login", "calls class user_name"]


def _score(s: str, p: str, o: str, q: V.Question) -> float:
    """The score of a triple, word by word."""
    text, asked = f"{s} {p} {o}", set(q.words)
    words = set(re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower().split())
    same = len(words & asked) / len(words | asked) if words | asked else 0.0
    plain = re.sub("[^A-Za-z0-9]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", text)).lower()
    related = min(1.0, same * 0.5 + sum(0.3 * w for t, w in q.terms for r in V.RELATED.get(t, ()) if r in plain))
    hs, hp, ho = (any(w in x.lower() for w in q.words) for x in (s, p, o))
    base = same * 0.3 + related * 0.25 + min(1.0, hs * 0.4 + hp * 0.4 + ho * 0.2 + (hs and hp) * 0.2) * 0.15
    low = text.lower()
    extra = 0.2 * bool(re.search("auth|login|token", low)) + 0.15 * bool(re.search("service|api|database", low))
    extra += 0.1 if re.search("depends|uses|calls", p.lower()) else 0.05 if p.lower().startswith("has") else 0.0
    return min(1.0, base + extra) if base > 0 else 0.0


def test_semantic_search_scores_of_odd_texts(spark):
    rows = [(s, p, o) for s in PARTS for p in ("", "aBcDeF", "hasType", "dependsOn") for o in PARTS] + [("a" * 20000, "usesLogin", "region")]
    store = spark.createDataFrame(rows, "subject string, predicate string, object string").coalesce(2).cache()
    for text in QUESTIONS:
        q = V.read_question(text)
        for threshold in (0.1, 0.0) if text == QUESTIONS[1] else (0.1,):
            got = V.semantic_search(store, q, len(rows), threshold).collect()
            want = {r: x for r in rows if (x := _score(*r, q)) >= threshold}
            assert {(r.subject, r.predicate, r.object) for r in got} == want.keys()
            assert all(abs(r.score - want[r.subject, r.predicate, r.object]) < 2e-6 for r in got)
            assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
            assert all(r.reason == "matches " + ", ".join(w for w in q.words if w in f"{r.subject} {r.predicate} {r.object}".lower()) for r in got)
            assert V.semantic_search(store, q, 7, threshold).collect() == got[:7]


def test_semantic_search_scores_each_triple_once(spark):
    """Of all triples only terms are looked for; the words are taken once from those that have one, in generated code."""
    store = spark.createDataFrame([("a", "b", "c")], "subject string, predicate string, object string")
    plan = V.semantic_search(store, V.read_question("user authentication login"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_replace(") == 6, plan
    assert "lambda" not in plan and "array_union" not in plan, plan
