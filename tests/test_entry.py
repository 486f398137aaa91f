from __future__ import annotations

import __spark_entry__ as entry


def test_registry():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 80
    for n in (6, 7):
        assert f"p{n}_found" in known


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "n"] and df.count() == 5


def test_queries_of_every_module_run(spark, small):
    known = entry.queries()
    for name in ("triple_exists", "rec_count_where", "graph_schema_summary", "cosine_topk", "module_rollup", "p7_report"):
        assert known[name](spark, small).count() > 0, name
