from __future__ import annotations

from datetime import datetime as T

from graphmill.operators import references as R

REL = "relationship_id long, from_id string, to_id string, rel_type string, ingested_at timestamp_ntz, side string, key string"
ENT = "entity_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, version string, name string"


def test_missing_deleted_late_and_shared(spark):
    ent = spark.createDataFrame(
        [("a", T(2025, 1, 1), None, "1", "x"), ("a", T(2025, 1, 1), None, "1", "x"), ("d", T(2025, 1, 1), T(2025, 1, 5), "1", "x"), ("l", T(2025, 2, 1), None, "1", "x"), (None, T(2025, 1, 1), None, "1", None), ("g", T(2025, 1, 1), T(2025, 1, 2), "1", ""), ("g", T(2025, 1, 4), None, "2", "")],
        ENT,
    )
    rel = spark.createDataFrame(
        [(1, "a", "m", "Calls", T(2025, 1, 3), "", ""), (2, "d", "a", "calls", T(2025, 1, 4), "", ""), (3, "d", "s", "CALLS", T(2025, 1, 5), "", ""), (4, "l", None, "USES", T(2025, 1, 9), "", ""), (4, "l", None, "USES", T(2025, 1, 9), "", ""), (5, "g", "g", "USES", T(2025, 1, 3), "", ""), (6, "a", "zz", None, None, "", "")],
        REL,
    )
    shared = spark.createDataFrame([("s",)], "entity_id string")
    found = {(r.relationship_id, r.side) for r in R.orphan_relationships(rel, ent, shared).collect()}
    assert found == {(1, "to"), (3, "from"), (4, "from"), (5, "from"), (5, "to"), (6, "from"), (6, "to")}
    report = {(r.rel_type, r.side, r.period): (r.n_references, r.n_orphans) for r in R.orphan_report(rel, ent, shared).collect()}
    assert report[("CALLS", "to", "2025-01")] == (3, 1) and report[("USES", "from", "2025-01")] == (2, 2)
    assert R.orphan_relationships(rel.limit(0), ent, shared).count() == 0
    assert R.orphan_relationships(rel, ent.limit(0), shared.limit(0)).select("relationship_id", "side").distinct().count() == 11


def test_hot_key_is_salted(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", None, "USES", T(2025, 1, 1 + i % 20, i % 24, i % 60, i // 400), "", "") for i in range(24_000)]
    rel = spark.createDataFrame(rows, REL)
    ent = spark.createDataFrame([("hot", T(2025, 1, 10), T(2025, 1, 15), "1", "")], ENT)
    got = R.orphan_relationships(rel, ent, spark.createDataFrame([], "entity_id string")).count()
    assert got == sum(1 for r in rows if not (r[1] == "hot" and T(2025, 1, 10) <= r[4] < T(2025, 1, 15)))
