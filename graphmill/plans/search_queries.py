"""Registered queries: retrieval, relevance, code measures, documents in Turtle and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import search as V
from ..session import table
from ..sources import turtle
from ..streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2025-12-31 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PAIRS = "(SELECT q.vec_id AS query_id, v.vec_id AS row_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)"


@query(f"SELECT query_id, row_id, n AS rank, round(s, 6) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS INTEGER) AS n FROM {_PAIRS}) WHERE n <= 10")
def cosine_topk(spark, d):
    """Every row whose id is divisible by 100 is a query against all rows."""
    e = table(spark, d, "embeddings")
    return V.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query_id", "row_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS n FROM {_PAIRS}) WHERE n <= 10 GROUP BY ALL")
def relevance_buckets(spark, d):
    e = table(spark, d, "embeddings")
    near = V.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    s = F.col("similarity")
    return near.groupBy("query_id", F.when(s >= 0.8, "high").when(s >= 0.6, "medium").otherwise("low").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH h AS (SELECT repository_id, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) AS h FROM (SELECT repository_id, unnest(string_split(name, '-')) AS w FROM repositories)),"
    " v AS (SELECT repository_id, i, avg(sin((h + i) * 0.1::DOUBLE)) AS x FROM h, range(100) r(i) GROUP BY ALL) SELECT repository_id, CAST(i AS INTEGER) AS dimension, round(x / sqrt(sum(x * x) OVER (PARTITION BY repository_id)), 6) AS value FROM v"
)
def hash_embedding(spark, d):
    """Vectors of names, a row a dimension."""
    e = table(spark, d, "repositories").select("repository_id", F.split("name", "-").alias("words"))
    return e.select("repository_id", F.posexplode(V.hash_embedding(F.col("words"))).alias("dimension", "x")).select("repository_id", "dimension", F.round("x", 6).alias("value"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, round(len(list_intersect(w, q)) * 1.0 / len(list_distinct(list_concat(w, q))), 6) AS jaccard FROM (SELECT doc_id, {_WORDS.format('text')} AS w, ['graph', 'index', 'shard', 'replica'] AS q FROM documents WHERE text IS NOT NULL) WHERE len(list_intersect(w, q)) > 0")
def set_intersection_jaccard(spark, d):
    q = F.array(*(F.lit(w) for w in ("graph", "index", "shard", "replica")))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", V.word_set(F.col("text")).alias("w"))
    return docs.where(F.arrays_overlap("w", q)).select("doc_id", F.round(V.jaccard(F.col("w"), q), 6).alias("jaccard"))


_OCCURS = "(length(low) - length(replace(low, '{0}', ''))) / {1}.0"


@query(
    f"SELECT doc_id, score FROM (SELECT doc_id, round(least(1.0, ({_OCCURS.format('graph', 5)} + {_OCCURS.format('snapshot', 8)}) / 2 / greatest(len(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+')), 1) * greatest(0.1, 1 - date_diff('day', CAST(created_at AS DATE), DATE '2025-12-31') / 30.0)), 9) AS score FROM (SELECT *, lower(text) AS low FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"
)
def context_rank(spark, d):
    """The 50 documents that fit two terms best, with a decay over 30 days before a fixed date."""
    docs = table(spark, d, "documents").where("text is not null and created_at is not null")
    age = F.datediff(F.lit(AS_OF).cast("timestamp_ntz"), F.col("created_at"))
    return docs.select("doc_id", F.round(V.context_score(F.col("text"), ["graph", "snapshot"], age), 9).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'ontology') AND doc_kind IN ('readme', 'runbook')")
def resource_search(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("ontology")) & F.col("doc_kind").isin("readme", "runbook")).select("doc_id", "source")


_FILES = "(SELECT entity_id, file_path, split_part(entity_id, ':', 2) AS language, max(source_code) AS source_code, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM code_entities WHERE entity_type = 'File' AND file_path IS NOT NULL GROUP BY ALL)"


@query(
    f"SELECT entity_id, round(p + l + c, 4) AS score FROM (SELECT entity_id, CASE WHEN folder = 'platform-core/app' THEN 0.4 WHEN starts_with(folder, 'platform-core/app/') THEN 0.25 ELSE 0.0 END AS p, CASE WHEN language = 'python' THEN 0.3 ELSE 0.0 END AS l,"
    f" CASE WHEN contains(lower(source_code), 'snapshot') THEN 0.2 ELSE 0.0 END AS c FROM {_FILES}) WHERE p + l + c >= 0.3 ORDER BY score DESC, entity_id LIMIT 100"
)
def file_relevance_a(spark, d):
    """Relevance of files to a place, a language and a word; the best 100 above the threshold."""
    f = table(spark, d, "code_entities").where("entity_type = 'File' and file_path is not null")
    files = f.groupBy("entity_id", "file_path").agg(F.max("source_code").alias("source_code"))
    score = V.proximity(F.col("file_path"), "platform-core/app") + F.when(F.split_part("entity_id", F.lit(":"), F.lit(2)) == "python", 0.3).otherwise(0.0) + F.when(F.contains(F.lower("source_code"), F.lit("snapshot")), 0.2).otherwise(0.0)
    return files.select("entity_id", F.round(score, 4).alias("score")).where("score >= 0.3").orderBy(F.desc("score"), "entity_id").limit(100)


@query(
    "SELECT doc_id, i AS chunk_index, substr(text, i * 900 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS INTEGER)) - 1)) AS i FROM documents WHERE length(text) > 0)"
)
def chunk_fixed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.inline(V.chunks(F.col("text"), 1000, 100)))
    return docs.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk")


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.ceil(F.length("text") / 4.0).alias("tokens"))


@query(
    "SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(?:owner|team|plan|release|budget)\\b')) AS business, len(regexp_extract_all(lower(text), '\\b(?:code|index|shard|cache|parser)\\b')) AS technical FROM documents WHERE text IS NOT NULL"
)
def composition_ratio(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.count_of(low, r"\b(?:owner|team|plan|release|budget)\b").cast("bigint").alias("business"), C.count_of(low, r"\b(?:code|index|shard|cache|parser)\b").cast("bigint").alias("technical"))


_HITS = "CAST(" + ") + CAST(".join("contains(lower(name), '{}') AS INTEGER".format(w) for w in ("repository", "store", "reader")) + ")"


@query(
    "SELECT pattern, count(*) AS n_classes, round(least(count(*) * w, 1.0), 4) AS confidence FROM (SELECT DISTINCT entity_id, name FROM code_entities WHERE entity_type = 'Class' AND name IS NOT NULL), (VALUES ('factory', 'factory|create', 0.3), ('observer', 'observer|listener|subscribe|notify', 0.25), ('repository', 'repository|dao|store', 0.4), ('service', 'service|manager|handler', 0.2)) p(pattern, re, w)"
    " WHERE regexp_matches(lower(name), re) GROUP BY pattern, w"
)
def pattern_confidence(spark, d):
    """Design patterns by the names of classes: min(hits * weight, 1)."""
    names = table(spark, d, "code_entities").where("entity_type = 'Class' and name is not null").select("entity_id", "name").distinct()
    found = F.filter(F.array(*(F.when(C.hits(F.col("name"), words) > 0, F.struct(F.lit(p).alias("pattern"), F.lit(w).alias("w"))) for p, (words, w) in C.PATTERNS.items())), lambda x: x.isNotNull())
    return names.select(F.explode(found).alias("f")).groupBy("f.pattern", "f.w").agg(F.count(F.lit(1)).alias("n_classes")).select("pattern", "n_classes", F.round(F.least(F.col("n_classes") * F.col("w"), F.lit(1.0)), 4).alias("confidence"))


@query(
    "SELECT doc_id, domain, hits, round(hits / 4.0, 4) AS confidence FROM (SELECT doc_id, domain, CAST(len(list_filter(string_split(words, '|'), lambda w: contains(lower(text), w))) AS INTEGER) AS hits FROM documents, (VALUES ('messaging', 'queue|stream|event|message'), ('storage', 'shard|replica|segment|journal'), ('security', 'token|secret|password|session'), ('graph', 'graph|vertex|edge|ontology')) x(domain, words) WHERE text IS NOT NULL) WHERE hits >= 2"
)
def domain_confidence(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    found = F.array(*(F.struct(F.lit(name).alias("domain"), C.hits(F.col("text"), words).alias("hits")) for name, words in C.DOMAINS.items()))
    return docs.select("doc_id", F.inline(found)).where("hits >= 2").select("doc_id", "domain", "hits", F.round(F.col("hits") / 4.0, 4).alias("confidence"))


@query(
    "SELECT entity_id, version, cc, round(greatest(0.0, 171 - 5.2 * ln(n) - 0.23 * cc), 4) AS maintainability, round(greatest(0.0, (cc - 10) * 0.5 + (cc - 15) * 0.3), 4) AS debt FROM (SELECT DISTINCT entity_id, version, len(string_split(source_code, chr(10))) AS n, CAST(1 + len(regexp_extract_all(source_code, '\\b(?:if|elif|for|while|case|catch|except)\\b')) + len(regexp_extract_all(source_code, '&&|\\|\\|')) AS INTEGER) AS cc FROM code_entities WHERE entity_type = 'File' AND source_code IS NOT NULL)"
)
def maintainability(spark, d):
    f = table(spark, d, "code_entities").where("entity_type = 'File' and source_code is not null")
    rows = f.select("entity_id", "version", C.cyclomatic(F.col("source_code")).cast("int").alias("cc"), F.size(F.split("source_code", "\n")).alias("n")).distinct()
    return rows.select("entity_id", "version", "cc", F.round(C.maintainability(F.col("n"), F.col("cc")), 4).alias("maintainability"), F.round(C.debt(F.col("cc"), F.col("cc")), 4).alias("debt"))


@query()
def regex_entities(spark, d):
    """Declarations of all files, by language and kind; checked on small files in the tests."""
    f = table(spark, d, "code_entities").where("entity_type = 'File' and source_code is not null")
    files = f.select("entity_id", "version", F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language"), "source_code")
    return C.declarations(files, "language", "source_code")


@query()
def turtle_entities(spark, d):
    """Statements of the knowledge documents; the parser is checked against exact documents in the tests."""
    docs = table(spark, d, "documents").where("doc_kind = 'knowledge_ttl' and text is not null").select("doc_id", "text")
    return turtle.read(docs, "doc_id", "text").select("path", "line_no", "subject", "predicate", "object", "object_type")


@query("SELECT DISTINCT entity_id, version FROM code_entities WHERE entity_type = 'File' AND regexp_matches(source_code, '(^|\\n)(<<<<<<<|>>>>>>>) ')")
def conflict_markers(spark, d):
    f = table(spark, d, "code_entities").where("entity_type = 'File'")
    return f.where(F.col("source_code").rlike(r"(^|\n)(<<<<<<<|>>>>>>>) ")).select("entity_id", "version").distinct()


@query("SELECT repository_id, n_files, CASE WHEN n_files < 500 THEN 'tiny' WHEN n_files < 2000 THEN 'small' WHEN n_files < 10000 THEN 'medium' ELSE 'large' END AS tier FROM (SELECT repository_id, count(DISTINCT entity_id) AS n_files FROM code_entities WHERE entity_type = 'File' GROUP BY 1)")
def size_tier(spark, d):
    n = table(spark, d, "code_entities").where("entity_type = 'File'").groupBy("repository_id").agg(F.count_distinct("entity_id").alias("n_files"))
    return n.withColumn("tier", C.size_tier(F.col("n_files")))


@query(
    "SELECT doc_id, CAST(m AS INTEGER) AS n_markers, CASE WHEN m >= 4 THEN 'complete' WHEN m >= 2 THEN 'partial' ELSE 'poor' END AS status FROM (SELECT doc_id, CAST(contains(text, '#') AS INTEGER) + CAST(contains(text, '```') AS INTEGER) + CAST(contains(text, '@') AS INTEGER) + CAST(contains(lower(text), 'see ') AS INTEGER) + CAST(length(text) > 500 AS INTEGER) AS m FROM documents WHERE text IS NOT NULL)"
)
def completeness(spark, d):
    t = F.col("text")
    m = sum((c.cast("int") for c in (F.contains(t, F.lit("```")), F.contains(t, F.lit("@")), F.contains(F.lower(t), F.lit("see ")), F.length(t) > 500)), F.contains(t, F.lit("#")).cast("int"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", m.alias("n_markers")).withColumn("status", F.when(F.col("n_markers") >= 4, "complete").when(F.col("n_markers") >= 2, "partial").otherwise("poor"))


@query(
    "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 6 * 3600 * 1000000::BIGINT THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)"
    " SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events FROM s GROUP BY user_id, k"
)
def debounce_sessions(spark, d):
    s = E.debounce(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n_events")


@query("SELECT event_id FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS w FROM events) WHERE w IS NULL OR w >= 3600 * 1000000::BIGINT")
def cooldown_filter(spark, d):
    return E.cooldown(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(avg(value), 6) AS mean_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1, 2")
def metrics_window(spark, d):
    m = E.windowed_metrics(table(spark, d, "events"), "event_type", "ts", "value", "1 day")
    return m.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", F.round("mean_value", 6).alias("mean_value"), "min_value", "max_value")


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events")
def running_average(spark, d):
    from pyspark.sql import Window

    run = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(run), 6).alias("running_mean"))
