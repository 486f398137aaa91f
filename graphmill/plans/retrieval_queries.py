"""Registered queries: retrieval of files, documents and triples for an assistant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relevance as V
from ..operators import retrieval as R
from ..operators.search import cosine
from ..session import table
from ..sources.star import triples

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, d):
    """File versions with their text, names and imports."""
    c = table(spark, d, "code_contexts").select("file_id", "version", "file_path", "functions.name", "classes", "imports").withColumnRenamed("name", "method_names")
    e = table(spark, d, "code_entities").where("entity_type = 'File'").groupBy(F.col("entity_id").alias("file_id"), "version").agg(F.max("source_code").alias("source_code"))
    named = c.select("file_id", "version", "file_path", F.split_part("file_id", F.lit(":"), F.lit(2)).alias("language"), "method_names", F.col("classes.name").alias("class_names"), F.col("imports.module").alias("imports"))
    return named.join(e, ["file_id", "version"], "left")


_F = """f AS (SELECT c.file_id, c.version, c.file_path, split_part(c.file_id, ':', 2) AS language, list_transform(functions, lambda x: x.name) AS method_names, list_transform(classes, lambda x: x.name) AS class_names,
  list_transform(imports, lambda x: x.module) AS imports, regexp_replace(c.file_path, '/?[^/]*$', '') AS folder, coalesce(e.source_code, '') AS source_code
  FROM code_contexts c LEFT JOIN (SELECT entity_id, version, max(source_code) AS source_code FROM code_entities WHERE entity_type = 'File' GROUP BY ALL) e ON e.entity_id = c.file_id AND e.version = c.version)"""
_ANY = "len(list_filter({0}, lambda n: contains(lower(n), '{1}') OR contains(lower(n), '{2}'))) > 0"


@query(
    f"WITH {_F}, s AS (SELECT file_id, version, least(1.0, CASE WHEN folder = 'platform-core/app' THEN 0.4 WHEN starts_with(folder, 'platform-core/app/') THEN 0.25 ELSE 0 END + CASE WHEN language = 'python' THEN 0.3 ELSE 0 END"
    " + CASE WHEN contains(lower(source_code), 'snapshot') OR contains(lower(source_code), 'ledger') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(source_code, '(?im)^\\s*(?:#|//|\\*|/\\*).*snapshot') OR regexp_matches(source_code, '(?im)^\\s*(?:#|//|\\*|/\\*).*ledger') THEN 0.15 ELSE 0 END"
    f" + CASE WHEN contains(lower(file_path), 'core') THEN 0.1 ELSE 0 END + CASE WHEN {_ANY.format('imports', 'snapshot', 'ledger')} THEN 0.15 ELSE 0 END + CASE WHEN {_ANY.format('class_names', 'snapshot', 'ledger')} THEN 0.15 ELSE 0 END + CASE WHEN {_ANY.format('method_names', 'snapshot', 'ledger')} THEN 0.1 ELSE 0 END) AS score FROM f)"
    " SELECT file_id, version, round(score, 4) AS score FROM s WHERE round(score, 4) >= 0.3 ORDER BY score DESC, file_id, version LIMIT 100"
)
def file_relevance_full(spark, d):
    """All eight terms of the relevance of a file; the best 100 from 0.3 on."""
    s = _files(spark, d).select("file_id", "version", F.round(R.file_relevance_full("platform-core/app", "python", ("snapshot", "ledger"), "core"), 4).alias("score"))
    return s.where("score >= 0.3").orderBy(F.desc("score"), "file_id", "version").limit(100)


_REQUEST = "platform-core/app/python/request.py"


@query(
    f"WITH {_F}, s AS (SELECT file_id, version, CASE WHEN folder = 'platform-core/app/python' THEN 0.5 WHEN starts_with(folder, 'platform-core/app/python/') OR starts_with('platform-core/app/python', folder || '/') THEN 0.3 ELSE 0 END"
    f" + CASE WHEN contains('{_REQUEST}', language) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(source_code), 'snapshot') THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter(imports, lambda m: m <> '' AND contains('{_REQUEST}', m))) > 0 THEN 0.2 ELSE 0 END AS score FROM f)"
    " SELECT file_id, version, round(score, 4) AS score FROM s WHERE round(score, 4) > 0.3 ORDER BY score DESC, file_id, version LIMIT 50"
)
def file_relevance_b(spark, d):
    s = _files(spark, d).select("file_id", "version", F.round(R.file_relevance_b(_REQUEST, "snapshot"), 4).alias("score"))
    return s.where("score > 0.3").orderBy(F.desc("score"), "file_id", "version").limit(50)


@query(
    f"WITH {_F}, n AS (SELECT *, string_split(folder, '/') AS there FROM f), m AS (SELECT *, CASE WHEN there[1] = 'platform-core' THEN CASE WHEN there[2] = 'app' THEN 2 ELSE 1 END ELSE 0 END AS same FROM n), t AS (SELECT *, 2 + len(there) - 2 * same AS steps FROM m)"
    " SELECT file_id, version, CAST(CASE WHEN steps = 0 THEN 14 WHEN steps <= 2 THEN 5 - steps ELSE 0 END + CASE WHEN contains(lower(source_code), 'snapshot') THEN 15 ELSE 0 END + CASE WHEN len(class_names) > 0 THEN 5 ELSE 0 END AS INTEGER) AS score FROM t"
    " ORDER BY score DESC, file_id, version LIMIT 5"
)
def file_relevance_c(spark, d):
    """The best five files by folders, query and a bonus, here for files with classes."""
    s = _files(spark, d).select("file_id", "version", R.file_relevance_c("platform-core/app/request.py", "snapshot", F.size("class_names") > 0).cast("int").alias("score"))
    return s.where("score > 0").orderBy(F.desc("score"), "file_id", "version").limit(5)


@query(
    f"WITH {_F} SELECT file_id, version, round(least(1.0, 0.5 + CASE WHEN file_path = '{_REQUEST}' THEN 0.4 WHEN contains(file_path, 'platform-core/app') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(source_code), 'snapshot') THEN 0.3 ELSE 0 END"
    " + CASE WHEN len(list_filter(class_names, lambda n: contains(lower(n), 'snapshot'))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(method_names, lambda n: contains(lower(n), 'snapshot'))) > 0 THEN 0.1 ELSE 0 END + CASE WHEN language = 'python' THEN 0.2 ELSE 0 END), 4) AS score FROM f"
)
def source_relevance_d(spark, d):
    return _files(spark, d).select("file_id", "version", F.round(R.file_relevance_d("platform-core/app/request.py", "python", "snapshot"), 4).alias("score"))


@query("SELECT doc_id, length(text) AS n_chars, true AS whole, true AS small, true AS numbered FROM documents WHERE length(text) > 0")
def chunk_recursive(spark, d):
    """Recursive chunks checked as a whole: per document their new parts cover the text, none is larger than 1,000, all are numbered."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = R.recursive_chunks(docs, "doc_id", "text")
    new = F.col("start_pos") + F.length("chunk") - F.col("new_pos")
    told = chunks.groupBy("doc_id").agg(
        F.sum(new).alias("n_chars"), F.bool_and(F.col("start_pos") <= F.col("new_pos")).alias("whole"), F.bool_and(F.length("chunk") <= 1000).alias("small"),
        (F.count_distinct("chunk_index") == F.max("n_chunks")).alias("numbered"),
    )
    return told


@query(
    "SELECT file_id, version, 'function' AS doc_type, f.name AS name, concat_ws(chr(10), coalesce(f.signature, f.name), f.docstring) AS content FROM (SELECT file_id, version, unnest(functions) AS f FROM code_contexts)"
    " UNION ALL SELECT file_id, version, 'class', k.name, 'class ' || coalesce(k.name, '') || ': ' || coalesce(array_to_string(k.methods, ', '), '') FROM (SELECT file_id, version, unnest(classes) AS k FROM code_contexts)"
    " UNION ALL SELECT file_id, version, 'imports', NULL, array_to_string(list_transform(imports, lambda x: x.module), chr(10)) FROM code_contexts WHERE len(imports) > 0"
)
def context_documents(spark, d):
    return R.context_documents(table(spark, d, "code_contexts"))


@query("SELECT doc_id FROM documents WHERE source = 'repo-platform-core' OR lower(lang) = 'fr' OR contains(lower(text), 'ontology') OR contains(lower(text), 'quota')")
def relevant_documents(spark, d):
    return R.relevant_documents(table(spark, d, "documents"), "repo-platform-core", "fr", "an ontology of quota").select("doc_id")


def _hashed(term: str) -> str:
    """DuckDB: the 32-bit rolling hash of an ASCII string."""
    return f"abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({term}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648))"


_VECTORS = (
    f"h AS (SELECT 'nation:' || n_nationkey AS subject, {_hashed(chr(39) + 'nation:' + chr(39) + ' || n_nationkey')} AS hs, {_hashed(chr(39) + 'inRegion' + chr(39))} AS hp, {_hashed(chr(39) + 'region:' + chr(39) + ' || n_regionkey')} AS ho FROM nation),"
    " v AS (SELECT subject, i, 0.4 * cos((hs + i) * 0.1::DOUBLE) + 0.4 * cos((hp + i) * 0.1::DOUBLE) + 0.2 * cos((ho + i) * 0.1::DOUBLE) AS x FROM h, range(100) r(i)), n AS (SELECT subject, i, x / sqrt(sum(x * x) OVER (PARTITION BY subject)) AS x FROM v)"
)


@query(f"WITH {_VECTORS} SELECT subject, CAST(i AS INTEGER) AS dimension, round(x, 6) AS value FROM n")
def triple_embedding(spark, d):
    t = triples(spark, d, ("inRegion",)).withColumn("vector", R.triple_vector())
    return t.select("subject", F.posexplode("vector").alias("dimension", "x")).select("subject", "dimension", F.round("x", 6).alias("value"))


@query(f"WITH {_VECTORS}, s AS (SELECT b.subject, sum(a.x * b.x) AS s FROM n a JOIN n b ON a.i = b.i AND a.subject = 'nation:3' AND b.subject <> 'nation:3' GROUP BY 1) SELECT subject, round(s, 6) AS similarity FROM s WHERE round(s, 6) >= 0.5")
def similar_triples(spark, d):
    """Triples whose vector is close to that of one given triple, whose vector is one row."""
    t = triples(spark, d, ("inRegion",)).withColumn("vector", R.triple_vector())
    given = F.array(*(F.lit(x) for x in t.where("subject = 'nation:3'").first().vector))
    close = t.where("subject <> 'nation:3'").select("subject", F.round(cosine(F.col("vector"), given), 6).alias("similarity"))
    return close.where("similarity >= 0.5")


@query("SELECT subject, predicate, object, 0.1::DOUBLE AS score FROM (SELECT 'region:' || r_regionkey AS subject, 'hasName' AS predicate, r_name AS object FROM region) ORDER BY subject LIMIT 3")
def search_fallback(spark, d):
    """A question that nothing fits gives three rows; the threshold follows the question and the size of the store."""
    store = triples(spark, d, ("hasName",)).where("subject like 'region:%'")
    question = V.read_question("zebra xylophone")
    scored = store.select("subject", "predicate", "object", V.structural_score(question).alias("score"))
    return R.at_least(scored, "score", R.threshold(question, 5), 3, F.desc("score"), F.asc("subject"))


@query(
    "SELECT doc_id, CASE WHEN p > 0 THEN array_to_string(list_slice(w, greatest(1, p - 1), p + 1), ' ') END AS snippet FROM (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(x)), 'snapshot') AS p FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[^ -~]+', ' ', 'g')), ' +') AS w FROM documents WHERE text IS NOT NULL)) WHERE p > 0"
)
def context_snippet(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace("text", "[^ -~]+", " ").alias("text"))
    return docs.select("doc_id", R.snippet(F.col("text"), "snapshot").alias("snippet")).where("snippet is not null")
