"""Registered queries: versions, synchronisation, validation and schema summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import versions as W
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STATES = (
    "e AS (SELECT entity_id, version, max(name) AS name, max(end_line) AS end_line, min(ingested_at) AS t FROM code_entities GROUP BY 1, 2),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t, version) AS n FROM e), o AS (SELECT * FROM r WHERE n = 1), w AS (SELECT * FROM r WHERE n = 2)"
)


def _states(spark, d) -> tuple[DataFrame, DataFrame]:
    """First and second version of each entity."""
    e = table(spark, d, "code_entities").groupBy("entity_id", "version").agg(F.max("name").alias("name"), F.max("end_line").alias("end_line"), F.min("ingested_at").alias("t"))
    n = e.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("t", "version")))
    return n.where("n = 1").select("entity_id", "name", "end_line"), n.where("n = 2").select("entity_id", "name", "end_line")


@query(f"WITH {_STATES} SELECT coalesce(o.entity_id, w.entity_id) AS entity_id, CASE WHEN o.entity_id IS NULL THEN 'created' WHEN w.entity_id IS NULL THEN 'deleted' WHEN o.name IS NOT DISTINCT FROM w.name AND o.end_line IS NOT DISTINCT FROM w.end_line THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN w ON o.entity_id = w.entity_id")
def real_version_diff(spark, d):
    old, new = _states(spark, d)
    return W.diff(old, new, ["entity_id"])


@query(f"WITH {_STATES} SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.entity_id IS NULL THEN 'created' WHEN w.entity_id IS NULL THEN 'deleted' WHEN o.name IS NOT DISTINCT FROM w.name AND o.end_line IS NOT DISTINCT FROM w.end_line THEN 'unchanged' ELSE 'updated' END AS change FROM o FULL JOIN w ON o.entity_id = w.entity_id) GROUP BY 1")
def sync_counts(spark, d):
    old, new = _states(spark, d)
    return W.sync_counts(new, old, ["entity_id"])


@query(f"WITH {_STATES} SELECT coalesce(w.entity_id, o.entity_id) AS entity_id, coalesce(w.name, o.name) AS name, coalesce(w.end_line, o.end_line) AS end_line FROM o FULL JOIN w ON o.entity_id = w.entity_id")
def conflict_merge(spark, d):
    old, new = _states(spark, d)
    return W.resolve(new, old, "entity_id", "merge", "end_line")


@query(
    "WITH n AS (SELECT entity_id AS id, min(entity_type) AS label FROM code_entities GROUP BY 1), r AS (SELECT DISTINCT from_id, to_id, upper(rel_type) AS rel_type FROM code_relationships),"
    " p AS (SELECT rel_type, a.label AS from_label, b.label AS to_label, count(*) AS n FROM r JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id GROUP BY ALL)"
    " SELECT *, CAST(row_number() OVER (PARTITION BY rel_type ORDER BY n DESC, from_label, to_label) AS INTEGER) AS rank FROM p QUALIFY rank <= 5"
)
def graph_schema_summary(spark, d):
    nodes = table(spark, d, "code_entities").groupBy(F.col("entity_id").alias("id")).agg(F.min("entity_type").alias("label"))
    edges = table(spark, d, "code_relationships").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.upper("rel_type").alias("rel_type")).distinct()
    return W.schema_summary(nodes, edges, "label")


_CHECKS = {
    "name_missing": "name IS NULL", "lines_reversed": "end_line < start_line", "no_repository": "repository_id IS NULL", "deleted_before_ingested": "deleted_at < ingested_at", "language_unknown": "language IS NULL AND entity_type = 'File'", "uri_malformed": "NOT contains(entity_id, ':')", "no_path": "file_path IS NULL",
}


@query("SELECT rule, count(*) AS n_violations FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _CHECKS.items()) + "], lambda x: x IS NOT NULL)) AS rule FROM code_entities) GROUP BY 1")
def validation_report(spark, d):
    """All rules over one scan: each row is exploded into the rules it breaks."""
    broken = F.filter(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in _CHECKS.items())), lambda x: x.isNotNull())
    return table(spark, d, "code_entities").select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations"))


@query("SELECT doc_kind, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_null, sum(CASE WHEN length(text) <> n_chars THEN 1 ELSE 0 END) AS n_stale, count(DISTINCT md5(text)) AS n_texts FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1")
def document_quality(spark, d):
    docs = table(spark, d, "documents").where("doc_kind is not null")
    return docs.groupBy("doc_kind").agg(F.sum(F.col("text").isNull().cast("int")).alias("n_null"), F.sum(F.when(F.length("text") != F.col("n_chars"), 1).otherwise(0)).alias("n_stale"), F.count_distinct(F.md5("text")).alias("n_texts"))


@query("SELECT status, count(*) AS n_repositories, count(last_analyzed) AS n_analyzed, max(last_analyzed) AS newest FROM repositories GROUP BY 1")
def queue_statistics(spark, d):
    return table(spark, d, "repositories").groupBy("status").agg(F.count(F.lit(1)).alias("n_repositories"), F.count("last_analyzed").alias("n_analyzed"), F.max("last_analyzed").alias("newest"))


@query("SELECT unnest(functions).name AS name, count(*) AS n FROM code_contexts GROUP BY 1 ORDER BY n DESC, name LIMIT 50")
def function_names(spark, d):
    return table(spark, d, "code_contexts").select(F.explode("functions").alias("f")).groupBy("f.name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(50)


@query(
    "SELECT file_id, version, m.module AS module, CAST(len(m.items) AS INTEGER) AS weight FROM (SELECT file_id, version, unnest(imports) AS m FROM code_contexts)"
)
def dependency_graph(spark, d):
    """Import edges of files with the number of imported names as weight."""
    c = table(spark, d, "code_contexts").select("file_id", "version", F.explode("imports").alias("m"))
    return c.select("file_id", "version", "m.module", F.when(F.col("m.items").isNotNull(), F.size("m.items")).alias("weight"))


@query(
    "SELECT file_id, version, 'hasFunction' AS predicate, f.name AS object FROM (SELECT file_id, version, unnest(functions) AS f FROM code_contexts) UNION ALL SELECT file_id, version, 'hasClass', c.name FROM (SELECT file_id, version, unnest(classes) AS c FROM code_contexts) UNION ALL SELECT file_id, version, 'imports', m.module FROM (SELECT file_id, version, unnest(imports) AS m FROM code_contexts)"
)
def ast_triples(spark, d):
    """Facts of analysed files as triples: functions, classes and imports from one scan."""
    c = table(spark, d, "code_contexts")
    part = lambda column, predicate, name: F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.struct(F.lit(predicate).alias("predicate"), x[name].alias("object")))
    facts = reduce(F.concat, (part("functions", "hasFunction", "name"), part("classes", "hasClass", "name"), part("imports", "imports", "module")))
    return c.select("file_id", "version", F.inline(facts))
