"""Registered queries: versions, incremental updates, caches, retention, reports and checks of Turtle documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workflow as W
from ..session import table
from ..sources.star import TRIPLES_SQL, triples

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_VERSIONS = "(SELECT repository_id, version AS commit_hash, min(last_modified) AS first_seen, count(*) AS n_rows FROM code_entities GROUP BY ALL)"


def _versions(spark, d):
    e = table(spark, d, "code_entities")
    return e.groupBy("repository_id", F.col("version").alias("commit_hash")).agg(F.min("last_modified").alias("first_seen"), F.count(F.lit(1)).alias("n_rows"))


@query(f"SELECT repository_id || '-' || substr(commit_hash, 1, 8) AS version_id, count(*) AS n FROM {_VERSIONS} WHERE repository_id NOT LIKE 'repo-platform%' GROUP BY 1")
def create_version(spark, d):
    """Versions that are not known yet, by a fixed id; those of one repository are known already."""
    v = _versions(spark, d)
    known = v.where("repository_id like 'repo-platform%'").select(W.version_id(F.col("repository_id"), F.col("commit_hash")).alias("version_id"))
    groups = v.withColumn("id", W.version_id(F.col("repository_id"), F.col("commit_hash"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    made = W.create_versions(known, v.unionByName(v))
    return made.select("version_id").join(groups, F.col("version_id") == F.col("id")).select("version_id", "n")


@query(f"SELECT repository_id, commit_hash, n_rows FROM {_VERSIONS} WHERE n_rows >= 5 ORDER BY first_seen DESC, repository_id, commit_hash LIMIT 20 OFFSET 5")
def version_query(spark, d):
    return W.page(_versions(spark, d), F.col("n_rows") >= 5, 5, 20, F.desc("first_seen"), F.asc("repository_id"), F.asc("commit_hash")).select("repository_id", "commit_hash", "n_rows")


_TWO = "(SELECT version, row_number() OVER (ORDER BY max(ingested_at) DESC, version) AS n FROM code_entities GROUP BY version)"


@query(
    f"WITH t AS {_TWO}, a AS (SELECT DISTINCT entity_id FROM code_entities WHERE version = (SELECT version FROM t WHERE n = 2)), b AS (SELECT DISTINCT entity_id FROM code_entities WHERE version = (SELECT version FROM t WHERE n = 1))"
    " SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN b.entity_id IS NULL THEN 'restore' WHEN a.entity_id IS NULL THEN 'remove' ELSE 'keep' END AS step FROM a FULL JOIN b ON a.entity_id = b.entity_id"
)
def rollback_steps(spark, d):
    """The return from the newest to the second newest version."""
    e = table(spark, d, "code_entities")
    two = [r.version for r in e.groupBy("version").agg(F.max("ingested_at").alias("t")).orderBy(F.desc("t"), "version").limit(2).collect()]
    return W.rollback(e, two[0], two[-1], "entity_id")


_MODULES = "(SELECT file_path, max(length(source_code)) AS n_chars, max(version) AS version FROM code_entities WHERE entity_type = 'File' AND file_path IS NOT NULL GROUP BY 1)"


def _modules(spark, d):
    e = table(spark, d, "code_entities").where("entity_type = 'File' and file_path is not null")
    return e.groupBy("file_path").agg(F.max(F.length("source_code")).alias("n_chars"), F.max("version").alias("version"))


@query(f"SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN n_chars * 2 ELSE n_chars END AS n_chars, CASE WHEN file_path LIKE '%.py' THEN 'next' ELSE version END AS version FROM {_MODULES} WHERE file_path NOT LIKE '%.go'")
def incremental_analysis(spark, d):
    """Python files changed and Go files were removed; only these are taken from the new analysis."""
    state = _modules(spark, d)
    fresh = state.where("file_path not like '%.go'").select("file_path", (F.col("n_chars") * 2).alias("n_chars"), F.lit("next").alias("version"))
    return W.incremental(state, fresh, state.where("file_path like '%.py' or file_path like '%.go'"), "file_path")


@query(f"SELECT file_path, coalesce(CASE WHEN file_path LIKE '%.json' THEN NULL WHEN file_path LIKE '%.java' THEN 0 END, n_chars) AS n_chars, CASE WHEN file_path LIKE '%.java' OR file_path LIKE '%.json' THEN 'next' ELSE version END AS version FROM {_MODULES}")
def module_merge(spark, d):
    """A merge keeps what the update leaves open."""
    state = _modules(spark, d)
    update = state.where("file_path like '%.java' or file_path like '%.json'").select("file_path", F.when(F.col("file_path").like("%.java"), F.lit(0)).alias("n_chars"), F.lit("next").alias("version"))
    return W.merge_module(state, update, "file_path", replace=False)


@query("SELECT DISTINCT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_:]+'), ['ontology', 'quota'])) > 0")
def cache_invalidation(spark, d):
    """Kept answers, here documents, that name something that was changed."""
    changed = spark.createDataFrame([("ontology",), ("Quota",)], "word string")
    return W.invalidated(table(spark, d, "documents").where("text is not null"), changed, "doc_id", "text")


@query("SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY max(ts), user_id) AS n, count(*) OVER () AS k FROM events GROUP BY user_id) WHERE n <= ceil(0.2 * k)")
def evict_fifth(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("t"))
    return W.evict_share(last, 0.2, F.asc("t"), F.asc("user_id")).select("user_id")


@query("SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY created_at DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used, sum(length(text)) OVER () AS total FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL) WHERE used <= 0.7 * total")
def memory_gc(spark, d):
    """The newest documents that fill 70 per cent of what all take."""
    docs = table(spark, d, "documents").where("text is not null and created_at is not null").select("doc_id", "created_at", F.length("text").cast("bigint").alias("size"))
    return W.keep_within(docs, "size", "created_at", "doc_id", 0.7).select("doc_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20') WHERE n <= 10")
def backup_retention(spark, d):
    return W.keep_backups(table(spark, d, "events"), "user_id", "ts", 10, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def best_template(spark, d):
    """The row of each kind with the highest score."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("r"))
    return e.select("event_type", "r.*")


@query(
    "SELECT doc_id, round(100 * exp(-0.01 * date_diff('day', CAST(created_at AS DATE), DATE '2026-01-01')) + CASE WHEN source = 'repo-platform-core' THEN 10 ELSE 0 END + CASE WHEN lang = 'en' THEN 5 ELSE 0 END, 4) AS score FROM documents WHERE created_at IS NOT NULL"
)
def decay_with_bonus(spark, d):
    """Decay over time with 10 for the same place and 5 for the same language."""
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.to_date("created_at"))
    bonus = F.when(F.col("source") == "repo-platform-core", 10).otherwise(0) + F.when(F.col("lang") == "en", 5).otherwise(0)
    return table(spark, d, "documents").where("created_at is not null").select("doc_id", F.round(F.exp(age * -0.01) * 100 + bonus, 4).alias("score"))


@query(f"WITH {TRIPLES_SQL} SELECT 'semantic:' || k AS index_key, count(*) AS n FROM (SELECT unnest([subject, predicate]) AS k FROM t WHERE predicate IN ('inRegion', 'inNation')) GROUP BY 1")
def semantic_index(spark, d):
    t = triples(spark, d, ("inRegion", "inNation"))
    keys = t.select(F.explode(F.array("subject", "predicate")).alias("k"))
    return keys.groupBy(F.concat(F.lit("semantic:"), F.col("k")).alias("index_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT field, value, count(*) AS n, min(o_orderkey) AS first_id FROM (SELECT o_orderkey, unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders) GROUP BY ALL")
def secondary_index(spark, d):
    o = table(spark, d, "orders")
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))))
    return o.select("o_orderkey", F.inline(entries)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("SELECT 'accepted' AS what, least(20, count(*)) AS n FROM nation UNION ALL SELECT 'refused', greatest(0, count(*) - 20) FROM nation")
def capacity_guard(spark, d):
    """A store that holds 20 triples at most takes as many as fit."""
    new = triples(spark, d, ("inRegion",)).agg(F.count(F.lit(1)).alias("k"))
    room = F.lit(20)
    rows = F.array(F.struct(F.lit("accepted").alias("what"), F.least(room, F.col("k")).alias("n")), F.struct(F.lit("refused").alias("what"), F.greatest(F.lit(0), F.col("k") - room).alias("n")))
    return new.select(F.inline(rows))


@query("SELECT entity_id, version, changed FROM (SELECT entity_id, version, coalesce(h <> lag(h) OVER (PARTITION BY entity_id ORDER BY seen_at, version), true) AS changed FROM (SELECT entity_id, version, min(ingested_at) AS seen_at, md5(min(source_code)) AS h FROM code_entities WHERE entity_type = 'File' AND source_code IS NOT NULL GROUP BY ALL))")
def changed_content(spark, d):
    """Which file versions have another content than the version before, by its digest."""
    from pyspark.sql import Window

    f = table(spark, d, "code_entities").where("entity_type = 'File' and source_code is not null").groupBy("entity_id", "version").agg(F.min("ingested_at").alias("at"), F.md5(F.min("source_code")).alias("h"))
    before = F.lag("h").over(Window.partitionBy("entity_id").orderBy("at", "version"))
    return f.select("entity_id", "version", F.coalesce(F.col("h") != before, F.lit(True)).alias("changed"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_kind = 'knowledge_ttl' AND text IS NOT NULL)"


def _lines(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'knowledge_ttl' and text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


_LINE = r"^([!-~]+) +([!-~]+) +([!-~].*?) *[.;]$"


@query(f"SELECT doc_id, s AS subject, p AS predicate, arg_max(o, n) AS object FROM (SELECT doc_id, n, regexp_extract(line, '{_LINE}', 1) AS s, regexp_extract(line, '{_LINE}', 2) AS p, regexp_extract(line, '{_LINE}', 3) AS o FROM {_LINES} WHERE regexp_matches(line, '{_LINE}')) GROUP BY ALL")
def turtle_lines_map(spark, d):
    """One statement a line; the last line of a subject and predicate counts."""
    part = lambda k: F.regexp_extract("line", _LINE, k)
    rows = _lines(spark, d).where(F.col("line").rlike(_LINE)).select("doc_id", "n", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))
    return rows.groupBy("doc_id", "subject", "predicate").agg(F.max_by("object", "n").alias("object"))


@query(f"SELECT doc_id, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad, count(*) FILTER (WHERE good AND contains(line, ' a ')) AS n_nodes FROM (SELECT doc_id, line, contains(line, ' ') AND (ends_with(line, '.') OR ends_with(line, ';')) AS good FROM {_LINES} WHERE line <> '') GROUP BY 1")
def turtle_line_checks(spark, d):
    """Lines that can be taken in: with a blank, and a full stop or semicolon at the end."""
    good = F.contains("line", F.lit(" ")) & (F.endswith("line", F.lit(".")) | F.endswith("line", F.lit(";")))
    rows = _lines(spark, d).where("line <> ''").withColumn("good", good)
    return rows.groupBy("doc_id").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), F.count_if(F.col("good") & F.contains("line", F.lit(" a "))).alias("n_nodes"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.;][ ]*\\n')) AS n_triples, len(regexp_extract_all(text, '[^ -~\\s]')) <= 10 AS plain, contains(text, '@prefix') AS has_prefix FROM documents WHERE doc_kind = 'knowledge_ttl' AND text IS NOT NULL")
def turtle_sync_check(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").where("doc_kind = 'knowledge_ttl' and text is not null")
    return docs.select("doc_id", F.regexp_count(t, F.lit(r"[.;][ ]*\n")).cast("bigint").alias("n_triples"), (F.regexp_count(t, F.lit(r"[^ -~\s]")) <= 10).alias("plain"), F.contains(t, F.lit("@prefix")).alias("has_prefix"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def cache_load(spark, d):
    """Rows of a JSON cache whose time to live, here `k`, has not run out."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k >= 50")


@query("SELECT source AS repository_id, count(*) AS n_files, sum(CAST(len(regexp_extract_all(text, '[.;][ ]*\\n')) AS BIGINT)) AS n_triples FROM (SELECT * FROM documents WHERE doc_kind = 'knowledge_ttl' AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, md5(text) ORDER BY ingested_at DESC, doc_id) = 1) GROUP BY 1")
def ttl_registry(spark, d):
    """Files and triples by repository, where a document that came again counts once, as it came last."""
    docs = table(spark, d, "documents").where("doc_kind = 'knowledge_ttl' and text is not null")
    last = docs.groupBy("source", F.md5("text").alias("h")).agg(F.max_by(F.regexp_count("text", F.lit(r"[.;][ ]*\n")), F.struct("ingested_at", -F.col("doc_id"))).alias("n"))
    return last.groupBy(F.col("source").alias("repository_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").cast("bigint").alias("n_triples"))


@query(
    "SELECT entity_id, version, e.key AS name, e.value.version AS package_version FROM (SELECT DISTINCT entity_id, version, unnest(map_entries(TRY_CAST(json_extract(TRY_CAST(source_code AS JSON), '$.packages') AS MAP(VARCHAR, STRUCT(version VARCHAR))))) AS e FROM code_entities WHERE entity_type = 'File' AND file_path LIKE '%.json' AND contains(source_code, '\"packages\"'))"
)
def lock_snapshot(spark, d):
    """Names and versions in lock files; texts that are no JSON have none."""
    f = table(spark, d, "code_entities").where("entity_type = 'File' and file_path like '%.json'").where(F.contains("source_code", F.lit('"packages"')))
    held = F.from_json("source_code", "packages map<string,struct<version:string>>")["packages"]
    return f.select("entity_id", "version", F.explode(held).alias("name", "p")).select("entity_id", "version", "name", F.col("p.version").alias("package_version")).distinct()


@query("SELECT k AS property, count(*) AS n, list_slice(list_sort(list(DISTINCT entity_type)), 1, 5) AS types FROM (SELECT unnest(map_keys(metadata)) AS k, entity_type FROM code_entities) GROUP BY 1 ORDER BY n DESC, property LIMIT 20")
def property_examples(spark, d):
    """The 20 most frequent properties with up to five types that have them."""
    p = table(spark, d, "code_entities").select(F.explode(F.map_keys("metadata")).alias("property"), "entity_type")
    told = p.groupBy("property").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("entity_type")), 1, 5).alias("types"))
    return told.orderBy(F.desc("n"), "property").limit(20)


_CX = "TRY_CAST(metadata['complexity'] AS DOUBLE)"


@query(
    f"WITH last AS (SELECT repository_id, arg_max(version, (last_modified, version)) AS version FROM code_entities GROUP BY 1) SELECT split_part(entity_id, ':', 2) AS language, count(*) AS n, round(avg({_CX}), 4) AS mean_complexity, max({_CX}) AS most, min({_CX}) AS least, count(*) FILTER (WHERE name IS NULL) AS n_errors"
    " FROM code_entities JOIN last USING (repository_id, version) WHERE entity_type IN ('Method', 'Function') GROUP BY 1"
)
def language_statistics_latest(spark, d):
    """Complexity by language in the latest version of each repository."""
    e = table(spark, d, "code_entities")
    last = e.groupBy("repository_id").agg(F.max_by("version", F.struct("last_modified", "version")).alias("version"))
    cx = F.element_at("metadata", "complexity").try_cast("double")
    own = e.join(last, ["repository_id", "version"], "left_semi").where("entity_type in ('Method', 'Function')")
    return own.groupBy(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(cx), 4).alias("mean_complexity"), F.max(cx).alias("most"), F.min(cx).alias("least"), F.count_if(F.col("name").isNull()).alias("n_errors")
    )


@query("SELECT count(*) AS n_methods, round(100.0 * count(*) FILTER (WHERE documentation.summary IS NOT NULL) / count(*), 4) AS coverage, round(avg(end_line - start_line + 1), 4) AS mean_lines, count(DISTINCT file_id) AS n_files FROM method_knowledge")
def batch_report(spark, d):
    m = table(spark, d, "method_knowledge")
    return m.agg(F.count(F.lit(1)).alias("n_methods"), F.round(F.count("documentation.summary") * 100.0 / F.count(F.lit(1)), 4).alias("coverage"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 4).alias("mean_lines"), F.count_distinct("file_id").alias("n_files"))


@query("SELECT name, entity_type, list_sort(list(DISTINCT entity_id)) AS ids FROM code_entities WHERE name IS NOT NULL AND entity_type IN ('Class', 'Function') GROUP BY ALL HAVING count(DISTINCT entity_id) > 1")
def duplicate_subjects(spark, d):
    """Names that stand for more than one class or function, with the ids."""
    e = table(spark, d, "code_entities").where("name is not null and entity_type in ('Class', 'Function')").select("name", "entity_type", "entity_id").distinct()
    return e.groupBy("name", "entity_type").agg(F.array_sort(F.collect_list("entity_id")).alias("ids")).where(F.size("ids") > 1)


@query(
    f"SELECT folder, list_sort(list(DISTINCT name) FILTER (WHERE entity_type = 'Class' AND name IS NOT NULL)) AS classes, count(*) FILTER (WHERE entity_type IN ('Method', 'Function')) AS n_methods, round(coalesce(sum(cx), 0), 4) AS complexity, round(greatest(20, 100 - 10 * coalesce(sum(cx), 0) / greatest(count(*) FILTER (WHERE entity_type IN ('Method', 'Function')), 1)), 4) AS maintainability"
    f" FROM (SELECT DISTINCT entity_id, version, entity_type, name, {_CX} AS cx, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM code_entities WHERE file_path IS NOT NULL) GROUP BY 1"
)
def module_rollup_full(spark, d):
    """Folders with their classes, methods, complexity and maintainability."""
    e = table(spark, d, "code_entities").where("file_path is not null").select("entity_id", "version", "entity_type", "name", F.element_at("metadata", "complexity").try_cast("double").alias("cx"), F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).distinct()
    made = e.groupBy("folder").agg(F.array_sort(F.collect_set(F.when(F.col("entity_type") == "Class", F.col("name")))).alias("classes"), F.count_if(F.col("entity_type").isin("Method", "Function")).alias("n_methods"), F.coalesce(F.sum("cx"), F.lit(0.0)).alias("cx"))
    rest = F.greatest(F.lit(20.0), 100 - F.col("cx") * 10 / F.greatest("n_methods", F.lit(1)))
    return made.select("folder", F.when(F.size("classes") > 0, F.col("classes")).alias("classes"), "n_methods", F.round("cx", 4).alias("complexity"), F.round(rest, 4).alias("maintainability"))


@query("SELECT split_part(entity_id, ':', 2) AS language, count(*) AS total, count(source_code) AS ok, count(*) - count(source_code) AS failed FROM code_entities WHERE entity_type = 'File' GROUP BY 1")
def analysis_summary(spark, d):
    f = table(spark, d, "code_entities").where("entity_type = 'File'")
    return f.groupBy(F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language")).agg(F.count(F.lit(1)).alias("total"), F.count("source_code").alias("ok"), (F.count(F.lit(1)) - F.count("source_code")).alias("failed"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\\bMATCH\\b')) + len(regexp_extract_all(text, '(?i)\\bWHERE\\b')) + 2 * len(regexp_extract_all(text, '(?i)\\bORDER BY\\b')) + 5 * len(regexp_extract_all(text, '\\*')) + 3 * len(regexp_extract_all(text, '(?i)shortestPath')) AS BIGINT) AS cost FROM documents WHERE text IS NOT NULL")
def query_cost(spark, d):
    """Estimated cost of a text as a graph query."""
    n = lambda p, w: F.regexp_count("text", F.lit(p)) * w
    cost = n(r"(?i)\bMATCH\b", 1) + n(r"(?i)\bWHERE\b", 1) + n(r"(?i)\bORDER BY\b", 2) + n(r"\*", 5) + n("(?i)shortestPath", 3)
    return table(spark, d, "documents").where("text is not null").select("doc_id", cost.cast("bigint").alias("cost"))
