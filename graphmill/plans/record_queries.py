"""Registered queries over records: selection, aggregation, ranking, budgets, versions and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators.traverse import distances
from ..session import table
from .recordsql import run as record_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 30 AND p_brand = 'Brand#13' ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def rec_select_where_order(spark, d):
    return record_sql(table(spark, d, "part"), "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 30 AND p_brand = 'Brand#13' ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_mktsegment), 'build') OR c_acctbal < 0) AND c_nationkey IN (1, 2, 3)")
def rec_contains(spark, d):
    return record_sql(table(spark, d, "customer"), "SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment contains 'BUILD' OR c_acctbal < 0) AND c_nationkey in (1, 2, 3)")


@query("SELECT r_regionkey, r_name FROM region WHERE contains(lower(r_regionkey || r_name), 'asia')")
def rec_find_text(spark, d):
    return record_sql(table(spark, d, "region"), "FIND asia")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def rec_count_where(spark, d):
    return record_sql(table(spark, d, "orders"), "COUNT WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")


@query("SELECT round(avg(o_totalprice), 4) AS value FROM orders")
def rec_aggregate(spark, d):
    return record_sql(table(spark, d, "orders"), "AGGREGATE o_totalprice avg").select(F.round("value", 4).alias("value"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def rec_get(spark, d):
    return record_sql(table(spark, d, "nation"), "GET 7", key="n_nationkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 1000000 + c_custkey, 'NEW' FROM customer WHERE c_custkey % 50 = 0")
def rec_upsert_merge(spark, d):
    """Delete, shallow merge of updates and insertion of new records, in two keyed joins."""
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    updates = base.where("c_custkey % 10 = 0").select("c_custkey", F.lit("VIP").alias("new"))
    deletes = base.where("c_custkey % 7 = 0").select("c_custkey")
    inserts = base.where("c_custkey % 50 = 0").select((F.lit(1_000_000) + F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("segment"))
    kept = base.join(deletes, "c_custkey", "left_anti").join(updates, "c_custkey", "left")
    return kept.select("c_custkey", F.coalesce("new", "segment").alias("segment")).unionByName(inserts)


@query("SELECT language, count(*) AS n_files, sum(length(source_code)) AS n_chars, max(length(source_code)) AS longest FROM (SELECT split_part(entity_id, ':', 2) AS language, source_code FROM code_entities WHERE entity_type = 'File') GROUP BY 1")
def language_breakdown(spark, d):
    files = table(spark, d, "code_entities").where("entity_type = 'File'").select(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language"), F.length("source_code").alias("n"))
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_chars"), F.max("n").alias("longest"))


@query("SELECT repository_id, count(DISTINCT version) AS n_versions, max(last_modified) AS last_update, count(*) AS n_rows FROM code_entities GROUP BY 1")
def repo_stats(spark, d):
    return table(spark, d, "code_entities").groupBy("repository_id").agg(F.count_distinct("version").alias("n_versions"), F.max("last_modified").alias("last_update"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT count(*) AS n_triples, count(*) FILTER (WHERE rel_type = 'CONTAINS') AS n_contains, count(*) FILTER (WHERE rel_type = 'CALLS') AS n_calls, count(DISTINCT from_id) AS n_subjects FROM (SELECT upper(rel_type) AS rel_type, from_id FROM code_relationships)")
def ontology_stats(spark, d):
    r = table(spark, d, "code_relationships").select(F.upper("rel_type").alias("t"), "from_id")
    return r.agg(F.count(F.lit(1)).alias("n_triples"), F.count_if(F.col("t") == "CONTAINS").alias("n_contains"), F.count_if(F.col("t") == "CALLS").alias("n_calls"), F.count_distinct("from_id").alias("n_subjects"))


@query("SELECT c_nationkey, count(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS n_credit, count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) AS n_building FROM customer GROUP BY 1")
def conditional_distinct(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count_distinct(F.when(F.col("c_acctbal") > 0, F.col("c_custkey"))).alias("n_credit"), F.count_distinct(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))).alias("n_building"))


@query(
    "SELECT folder, count(*) AS n_files, CAST(sum(n_functions) AS BIGINT) AS n_functions, CAST(sum(n_classes) AS BIGINT) AS n_classes FROM (SELECT regexp_replace(file_path, '/[^/]*$', '') AS folder, coalesce(len(functions), 0) AS n_functions, coalesce(len(classes), 0) AS n_classes FROM code_contexts) GROUP BY 1"
)
def module_rollup(spark, d):
    c = table(spark, d, "code_contexts").select(F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"), F.coalesce(F.size("functions"), F.lit(0)).alias("f"), F.coalesce(F.size("classes"), F.lit(0)).alias("k"))
    return c.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.greatest("f", F.lit(0))).alias("n_functions"), F.sum(F.greatest("k", F.lit(0))).alias("n_classes"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"))


@query("SELECT event_type, round(min(value), 6) AS fastest, round(max(value), 6) AS slowest, round(avg(value), 6) AS mean, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY 1")
def layer_latency(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.min(v), 6).alias("fastest"), F.round(F.max(v), 6).alias("slowest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.avg(F.when(v < 50, 1.0).otherwise(0.0)), 6).alias("success_rate"))


@query("SELECT round(sum(n - 1) * 1.0 / sum(n), 8) AS hit_rate FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def cache_hit_rate(spark, d):
    """The first access of a key misses, all others hit."""
    keys = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.round(F.sum(F.col("n") - 1) / F.sum("n"), 8).alias("hit_rate"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_score(spark, d):
    return K.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


_DOC_TOKENS = "SELECT doc_id, source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, length(text) AS score FROM documents WHERE text IS NOT NULL"


def _docs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.ceil(F.length("text") / 4.0).alias("tokens"), F.length("text").alias("score"))


@query(f"SELECT doc_id, source, CAST(used AS BIGINT) AS used_tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY score, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM ({_DOC_TOKENS})) WHERE used <= 2000")
def budget_prefix(spark, d):
    return K.budget_prefix(_docs(spark, d), "source", "tokens", 2000, F.col("score"), F.col("doc_id")).select("doc_id", "source", "used_tokens")


@query(f"SELECT doc_id, source FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY score, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({_DOC_TOKENS})) WHERE b < 2000")
def budget_overshoot(spark, d):
    return K.budget_overshoot(_docs(spark, d), "source", "tokens", 2000, F.col("score"), F.col("doc_id")).select("doc_id", "source")


_FOLD = f"WITH RECURSIVE o AS (SELECT source, doc_id, tokens, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM ({_DOC_TOKENS})),"


@query(
    f"{_FOLD} f AS (SELECT source, 0::BIGINT AS n, NULL::BIGINT AS doc_id, 0::BIGINT AS used, NULL::BIGINT AS taken FROM o WHERE n = 1 UNION ALL SELECT o.source, o.n, o.doc_id, CASE WHEN o.tokens <= 2000 - f.used THEN f.used + o.tokens ELSE f.used END, CASE WHEN o.tokens <= 2000 - f.used THEN o.tokens END FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)"
    " SELECT source, doc_id, taken FROM f WHERE taken IS NOT NULL"
)
def budget_skip(spark, d):
    """Best documents of each source; those that do not fit into the rest of the budget are skipped."""
    return K.budget_fold(_docs(spark, d), "source", "doc_id", "tokens", "score", 2000)


@query(
    f"{_FOLD} f AS (SELECT source, 0::BIGINT AS n, NULL::BIGINT AS doc_id, 0::BIGINT AS used, NULL::BIGINT AS taken, false AS over FROM o WHERE n = 1 UNION ALL SELECT o.source, o.n, o.doc_id, f.used + CASE WHEN o.tokens <= 2000 - f.used THEN o.tokens WHEN 2000 - f.used > 100 THEN 2000 - f.used ELSE 0 END,"
    " CASE WHEN o.tokens <= 2000 - f.used THEN o.tokens WHEN 2000 - f.used > 100 THEN 2000 - f.used END, o.tokens > 2000 - f.used FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1 WHERE NOT f.over) SELECT source, doc_id, taken FROM f WHERE taken IS NOT NULL"
)
def budget_truncate(spark, d):
    """As budget_skip, but the first that does not fit is cut if more than 100 tokens remain, and ends the list."""
    return K.budget_fold(_docs(spark, d), "source", "doc_id", "tokens", "score", 2000, truncate=100)


_ACCESS = "SELECT user_id, event_type, max(ts) AS last_access, count(*) AS n_access FROM events GROUP BY 1, 2"


def _access(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_access"), F.count(F.lit(1)).alias("n_access"))


@query(f"SELECT user_id, event_type FROM ({_ACCESS}) ORDER BY last_access, user_id, event_type LIMIT 50")
def evict_lru(spark, d):
    return K.top_k(_access(spark, d), 50, F.col("last_access"), F.col("user_id"), F.col("event_type")).select("user_id", "event_type")


@query(f"SELECT user_id, event_type FROM ({_ACCESS}) ORDER BY n_access, user_id, event_type LIMIT 50")
def evict_lfu(spark, d):
    return K.top_k(_access(spark, d), 50, F.col("n_access"), F.col("user_id"), F.col("event_type")).select("user_id", "event_type")


@query(f"SELECT user_id, event_type, n_access FROM ({_ACCESS}) WHERE last_access + INTERVAL 2 DAY > TIMESTAMP '2024-01-31 00:00:00'")
def ttl_expiry(spark, d):
    """Entries still alive two days after their last access."""
    return _access(spark, d).where("last_access + interval 2 days > timestamp_ntz'2024-01-31 00:00:00'").select("user_id", "event_type", "n_access")


@query("SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def idle_expiry(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).where("last < timestamp_ntz'2024-01-30 12:00:00'").select("user_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def last_n_messages(spark, d):
    return K.keep_last(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", 10, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


_VERSIONS = "SELECT repository_id, version, min(ingested_at) AS first_seen FROM code_entities WHERE repository_id IS NOT NULL GROUP BY 1, 2"


def _versions(spark, d):
    return table(spark, d, "code_entities").where("repository_id is not null").groupBy("repository_id", "version").agg(F.min("ingested_at").alias("first_seen"))


@query(f"SELECT repository_id, version, CASE WHEN row_number() OVER (PARTITION BY repository_id ORDER BY first_seen DESC, version DESC) > 1 THEN 'archived' ELSE 'active' END AS status FROM ({_VERSIONS})")
def archive_old_versions(spark, d):
    n = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("first_seen"), F.desc("version")))
    return _versions(spark, d).select("repository_id", "version", F.when(n > 1, "archived").otherwise("active").alias("status"))


@query(f"SELECT repository_id, version, lag(version) OVER (PARTITION BY repository_id ORDER BY first_seen, version) AS parent_version FROM ({_VERSIONS})")
def parent_version(spark, d):
    return _versions(spark, d).select("repository_id", "version", F.lag("version").over(Window.partitionBy("repository_id").orderBy("first_seen", "version")).alias("parent_version"))


@query("SELECT o_orderkey, w FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END AS w, o_orderdate FROM orders) ORDER BY w DESC, o_orderdate, o_orderkey LIMIT 40")
def priority_queue(spark, d):
    p = F.col("o_orderpriority")
    weight = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "5-LOW", 1).otherwise(2)
    return table(spark, d, "orders").select("o_orderkey", weight.alias("w"), "o_orderdate").orderBy(F.desc("w"), "o_orderdate", "o_orderkey").limit(40).select("o_orderkey", "w")


@query("SELECT entity_id, arg_max(version, ingested_at) AS version FROM (SELECT entity_id, version, max(ingested_at) AS ingested_at FROM code_entities WHERE entity_type = 'Package' GROUP BY 1, 2) GROUP BY 1")
def latest_per_entity(spark, d):
    e = table(spark, d, "code_entities").where("entity_type = 'Package'")
    return e.groupBy("entity_id").agg(F.max_by("version", "ingested_at").alias("version"))


@query("SELECT file_path, entity_id FROM (SELECT file_path, entity_id, row_number() OVER (PARTITION BY file_path ORDER BY entity_type, entity_id, version, ingested_at) AS n FROM code_entities WHERE file_path IS NOT NULL) WHERE n = 1")
def dedup_first(spark, d):
    e = table(spark, d, "code_entities").where("file_path is not null").select("file_path", "entity_id", "entity_type", "version", "ingested_at")
    return K.first_of(e, "file_path", *(F.col(c) for c in ("entity_type", "entity_id", "version", "ingested_at"))).select("file_path", "entity_id")


@query("SELECT event_id, round(value * exp(-(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) / 60.0 * 0.0001), 6) AS score FROM events ORDER BY value * exp(-(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) / 60.0 * 0.0001) DESC, event_id LIMIT 30")
def decay_order(spark, d):
    as_of = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    age = (as_of.cast("double") - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 60
    scored = table(spark, d, "events").withColumn("raw", F.col("value") * F.exp(-age * 0.0001))
    return scored.orderBy(F.desc("raw"), "event_id").limit(30).select("event_id", F.round("raw", 6).alias("score"))


@query(
    "WITH p AS (SELECT split_part(entity_id, ':', 2) AS lang, file_path, version, md5(coalesce(source_code, '')) AS h, row_number() OVER (PARTITION BY entity_id ORDER BY version) AS n FROM (SELECT DISTINCT entity_id, file_path, version, source_code FROM code_entities WHERE entity_type = 'File')),"
    " a AS (SELECT lang, file_path, min(h) AS h FROM p WHERE n = 1 GROUP BY ALL), b AS (SELECT lang, file_path, min(h) AS h FROM p WHERE n = 2 GROUP BY ALL)"
    " SELECT coalesce(a.lang, b.lang) AS lang, CASE WHEN a.h IS NULL THEN 'created' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM a FULL JOIN b ON a.lang = b.lang AND a.file_path = b.file_path GROUP BY ALL"
)
def version_file_diff(spark, d):
    """First against second analysed version of each file: a full outer join on the path of content hashes."""
    f = table(spark, d, "code_entities").where("entity_type = 'File'").select("entity_id", "file_path", "version", "source_code").distinct()
    p = f.select(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("lang"), "file_path", F.md5(F.coalesce("source_code", F.lit(""))).alias("h"), F.row_number().over(Window.partitionBy("entity_id").orderBy("version")).alias("n"))
    a = p.where("n = 1").groupBy("lang", "file_path").agg(F.min("h").alias("old"))
    b = p.where("n = 2").groupBy("lang", "file_path").agg(F.min("h").alias("new"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return a.join(b, ["lang", "file_path"], "full_outer").groupBy("lang", change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)"
    " SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'updated' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"
)
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    snap = lambda day, name: o.where(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = snap("1996-01-01", "a").join(snap("1997-01-01", "b"), "k", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT entity_id, version, max(name) AS name, max(ingested_at) AS t FROM code_entities WHERE entity_type = 'Class' GROUP BY 1, 2), l AS (SELECT entity_id, arg_max(name, t) AS lww FROM v WHERE name IS NOT NULL GROUP BY 1) SELECT entity_id, lww AS name FROM l")
def conflict_lww(spark, d):
    """Last write wins among the versions of an entity; a null never overwrites a name."""
    v = table(spark, d, "code_entities").where("entity_type = 'Class'").groupBy("entity_id", "version").agg(F.max("name").alias("name"), F.max("ingested_at").alias("t"))
    return v.where("name is not null").groupBy("entity_id").agg(F.max_by("name", "t").alias("name"))


@query("SELECT doc_id FROM documents JOIN repositories ON source = repository_id WHERE contains(text, name) UNION SELECT doc_id FROM documents JOIN repositories ON source = repository_id WHERE status = 'inactive'")
def or_match(spark, d):
    """A join on a disjunction, as two equi-joins whose union is made distinct."""
    both = table(spark, d, "documents").join(table(spark, d, "repositories"), F.col("source") == F.col("repository_id"))
    return both.where(F.contains("text", "name")).select("doc_id").unionByName(both.where("status = 'inactive'").select("doc_id")).distinct()


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM code_relationships WHERE upper(rel_type) IN ('CALLS', 'CONTAINS') AND to_id IS NOT NULL),"
    " w AS (SELECT DISTINCT repository_id AS node0, entity_id AS node, 0 AS steps FROM code_entities WHERE entity_type = 'Package' AND repository_id = 'repo-platform-core' UNION SELECT w.node0, e.dst, w.steps + 1 FROM w JOIN e ON e.src = w.node WHERE w.steps < 40)"
    " SELECT node, min(steps) AS steps FROM w GROUP BY 1"
)
def bfs_shortest(spark, d):
    r = table(spark, d, "code_relationships").where("upper(rel_type) in ('CALLS', 'CONTAINS')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    start = table(spark, d, "code_entities").where("entity_type = 'Package' and repository_id = 'repo-platform-core'").select(F.col("entity_id").alias("node"))
    return distances(r, start)
