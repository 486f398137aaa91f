"""Registered queries: semantic search, code analysis, module cycles and routing advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import relevance as V
from ..operators.hierarchy import clean_links, cyclic_members
from ..operators.versions import cacheable, query_complexity
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
    f = table(spark, d, "code_entities").where("entity_type = 'File' and source_code is not null")
    return f.select("entity_id", "version", F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language"), "source_code").distinct()


_FILES = "(SELECT DISTINCT entity_id, version, split_part(entity_id, ':', 2) AS language, source_code FROM code_entities WHERE entity_type = 'File' AND source_code IS NOT NULL)"


@query()
def semantic_search(spark, d):
    """The 25 facts of the star schema that fit a question best; checked in the tests."""
    return V.semantic_search(triples(spark, d), V.read_question("customer segment building region"), 25)


@query("SELECT n_nationkey || ' in region ' || n_regionkey AS sentence FROM nation UNION ALL SELECT c_custkey || ' in nation ' || c_nationkey FROM customer UNION ALL SELECT s_suppkey || ' in nation ' || s_nationkey FROM supplier UNION ALL SELECT p_partkey || ' has brand ' || split_part(p_brand, '#', 2) FROM part")
def triple_sentences(spark, d):
    return triples(spark, d, ("inRegion", "inNation", "hasBrand")).select(V.sentence().alias("sentence"))


_DECISIONS = {
    "typescript": r"\b(?:if|case|while|do|for)\b|&&|\|\|", "javascript": r"\b(?:if|case|while|do|for)\b|&&|\|\|", "python": r"\b(?:if|elif|while|for|try|with)\b", "java": r"\b(?:if|else|while|for|switch|case|catch)\b|\?", "go": r"\b(?:if|else|for|switch|case|select)\b",
}


@query(" UNION ALL ".join(f"SELECT language, count(*) AS n_files, CAST(sum(len(regexp_extract_all(source_code, '{p}')) + 1) AS BIGINT) AS complexity FROM {_FILES} WHERE language = '{g}' GROUP BY 1" for g, p in _DECISIONS.items()))
def language_complexity(spark, d):
    """Decisions by language. The conditional operator of scripts counts in the operator's own form, but not here, where the two regex dialects must agree."""
    f = _files(spark, d).where(F.col("language").isin(*_DECISIONS))
    n = C.complexity(F.col("language"), F.col("source_code"))
    ternary = F.when(F.col("language").isin("typescript", "javascript"), C.count_of(F.col("source_code"), r"\?(?![.?:])")).otherwise(0)
    return f.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(n - ternary).alias("complexity"))


_CALL = "(new\\s+[A-Z]\\w*|(?:[A-Za-z_]\\w*\\.)?[A-Za-z_]\\w*)\\("


@query(
    f"SELECT entity_id, version, line_no, CASE WHEN starts_with(c, 'new ') THEN 'new' ELSE nullif(regexp_extract(c, '^(\\w+)\\.', 1), '') END AS receiver, regexp_extract(c, '(\\w+)$', 1) AS name FROM (SELECT entity_id, version, CAST(n AS INTEGER) AS line_no, unnest(regexp_extract_all(line, '{_CALL}', 1)) AS c"
    f" FROM (SELECT entity_id, version, unnest(string_split(source_code, chr(10))) AS line, generate_subscripts(string_split(source_code, chr(10)), 1) AS n FROM {_FILES}) WHERE contains(line, '(')) WHERE c NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'def', 'func', 'elif', 'and', 'or', 'not', 'in', 'print')"
)
def call_extraction(spark, d):
    """Calls of all files with their lines."""
    return C.calls(_files(spark, d).select("entity_id", "version", "source_code"), "source_code")


@query()
def python_ast(spark, d):
    """Facts of all Python files by their syntax trees; checked on small files in the tests."""
    return C.python_ast(_files(spark, d).where("language = 'python'").select("entity_id", "source_code"), "source_code")


_DEPS = "(SELECT DISTINCT from_id AS src, to_id AS dst FROM code_relationships WHERE upper(rel_type) IN ('IMPORTS', 'USES', 'DEPENDS_ON', 'EXTENDS', 'INHERITS') AND to_id IS NOT NULL)"


@query(f"WITH RECURSIVE e AS {_DEPS}, c AS (SELECT src AS start, dst AS node FROM e UNION SELECT c.start, e.dst FROM c JOIN e ON e.src = c.node) SELECT DISTINCT start AS entity_id FROM c WHERE start = node")
def cycle_edges(spark, d):
    """Entities on a cycle of imports, uses or inheritance, whatever the number of links of an entity."""
    r = table(spark, d, "code_relationships").where("upper(rel_type) in ('IMPORTS', 'USES', 'DEPENDS_ON', 'EXTENDS', 'INHERITS')")
    return cyclic_members(clean_links(r, "to_id", "from_id")).select(F.col("member").alias("entity_id"))


@query(
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'depends|path|calls') THEN 'graph' WHEN regexp_matches(lower(text), 'count|sum|average') THEN 'records' ELSE 'search' END AS layer, NOT regexp_matches(lower(text), '\\b(?:now|rand|timestamp|current_time)\\b\\s*\\(?') AS cacheable FROM documents WHERE text IS NOT NULL"
)
def routing_advice(spark, d):
    """Where a text would be answered and whether the answer may be kept."""
    docs = table(spark, d, "documents").where("text is not null")
    low = F.lower("text")
    layer = F.when(low.rlike("depends|path|calls"), "graph").when(low.rlike("count|sum|average"), "records").otherwise("search")
    return docs.select("doc_id", layer.alias("layer"), cacheable(F.col("text")).alias("cacheable"))


_COUNT = "len(regexp_extract_all(upper(text), '{}'))"
_SCORE = " + ".join(f"{w} * {_COUNT.format(p)}" for p, w in (("\\bUNION\\b", 2), ("\\bOPTIONAL\\b", 1), ("\\bFILTER\\b", 1), ("\\bGROUP BY\\b", 2), ("\\bORDER BY\\b", 1)))


@query(f"SELECT doc_id, CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM (SELECT doc_id, {_SCORE} + CASE WHEN len(regexp_extract_all(text, '\\{{')) > 2 THEN 1 ELSE 0 END AS s FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' filter and filter' WHEN 2 THEN ' union group by' ELSE ' order by' END AS text FROM documents WHERE text IS NOT NULL))")
def query_complexity_levels(spark, d):
    """Complexity of all texts as queries; words of the language are added by turns, so that every level comes up."""
    docs = table(spark, d, "documents").where("text is not null")
    added = F.expr("case doc_id % 4 when 0 then '' when 1 then ' filter and filter' when 2 then ' union group by' else ' order by' end")
    return docs.select("doc_id", query_complexity(F.concat("text", added)).alias("complexity"))


@query("SELECT method_id, (CASE WHEN documentation.summary IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN documentation.description IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(documentation.tags) > 0 THEN 1 ELSE 0 END) / 3.0 AS documentation_score FROM method_knowledge")
def documentation_score(spark, d):
    m = table(spark, d, "method_knowledge")
    part = lambda c: F.when(c, 1).otherwise(0)
    score = part(F.col("documentation.summary").isNotNull()) + part(F.col("documentation.description").isNotNull()) + part(F.size("documentation.tags") > 0)
    return m.select("method_id", (score / F.lit(3.0)).alias("documentation_score"))


@query("SELECT visibility, count(*) AS n_methods, count(*) FILTER (WHERE is_static) AS n_static, count(*) FILTER (WHERE is_async) AS n_async, round(avg(end_line - start_line + 1), 4) AS mean_lines FROM method_knowledge GROUP BY 1")
def method_statistics(spark, d):
    m = table(spark, d, "method_knowledge")
    return m.groupBy("visibility").agg(F.count(F.lit(1)).alias("n_methods"), F.count_if("is_static").alias("n_static"), F.count_if("is_async").alias("n_async"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 4).alias("mean_lines"))


@query("SELECT method_id, list_filter([CASE WHEN regexp_matches(lower(name), '^(?:set|update|write|store|publish)') THEN 'writes' END, CASE WHEN regexp_matches(lower(name), '^(?:load|read|fetch|get)') THEN 'reads' END, CASE WHEN regexp_matches(lower(name), '^(?:remove|delete|drop|prune)') THEN 'removes' END], lambda x: x IS NOT NULL) AS effects FROM method_knowledge")
def side_effects(spark, d):
    low = F.lower("name")
    tags = F.array(*(F.when(low.rlike("^(?:" + words + ")"), F.lit(tag)) for tag, words in (("writes", "set|update|write|store|publish"), ("reads", "load|read|fetch|get"), ("removes", "remove|delete|drop|prune"))))
    return table(spark, d, "method_knowledge").select("method_id", F.array_compact(tags).alias("effects"))


_OUTLINE = {
    "n_functions": r"(?m)^[ \t]*(?:export )?(?:async )?(?:def|func|function) [A-Za-z_]", "n_classes": r"(?m)^[ \t]*(?:export )?(?:public )?(?:abstract )?class [A-Za-z_]", "n_imports": r"(?m)^[ \t]*(?:import|from) ", "n_exports": "(?m)^export ", "n_params": "(?m)@param ",
}


@query("SELECT entity_id, version, " + ", ".join(f"CAST(len(regexp_extract_all(source_code, '{p}')) AS BIGINT) AS {c}" for c, p in _OUTLINE.items()) + f" FROM {_FILES}")
def code_outline(spark, d):
    """What the text of each file seems to declare."""
    return _files(spark, d).select("entity_id", "version", C.outline(F.col("source_code")).alias("o")).select("entity_id", "version", "o.*")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(m, '^\\.|^mod\\.example/') THEN 'internal' WHEN split_part(m, '.', 1) IN ('os', 'sys', 're', 'json', 'logging', 'java', 'fmt', 'fs') THEN 'builtin' ELSE 'external' END AS kind FROM (SELECT unnest(list_transform(imports, lambda x: x.module)) AS m FROM code_contexts) WHERE m IS NOT NULL) GROUP BY 1")
def dependency_classes(spark, d):
    m = table(spark, d, "code_contexts").select(F.explode("imports.module").alias("m")).where("m is not null")
    kind = C.dependency_class(F.col("m"), ("os", "sys", "re", "json", "logging", "java", "fmt", "fs"))
    return m.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_id, version, " + " OR ".join(f"contains(lower(source_code), '{m}')" for m in C.HAND_MARKS) + f" AS touched FROM {_FILES}")
def developer_modified(spark, d):
    return _files(spark, d).select("entity_id", "version", C.hand_modified(F.col("source_code")).alias("touched"))


@query("SELECT doc_id, len(regexp_extract_all(text, ' a code:Function ')) AS n_functions, len(regexp_extract_all(text, 'code:dependsOn ')) AS n_dependencies, list_sort(list_distinct(regexp_extract_all(text, '@prefix (\\w+):', 1))) AS prefixes, regexp_extract(text, 'code:owner \"([^\"]*)\"', 1) AS owner FROM documents WHERE doc_kind = 'knowledge_ttl' AND text IS NOT NULL")
def ttl_metadata(spark, d):
    """Functions, dependencies, prefixes and the owner that a knowledge document names."""
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    docs = table(spark, d, "documents").where("doc_kind = 'knowledge_ttl' and text is not null")
    return docs.select("doc_id", n(" a code:Function ").alias("n_functions"), n("code:dependsOn ").alias("n_dependencies"), F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"@prefix (\w+):"), F.lit(1)))).alias("prefixes"), F.regexp_extract(t, 'code:owner "([^"]*)"', 1).alias("owner"))
