"""Registered queries over triples: patterns, SPARQL, joins and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import triples as T
from ..operators.hierarchy import strong_parts
from ..operators.traverse import shortest_path as path_between
from ..session import table
from ..sources.star import TRIPLES_SQL, triples
from .sparql import sparql

QUERIES: dict = {}
SQL: dict[str, str] = {}
ALL = ("customer", "supplier")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ask(spark: SparkSession, d: str, text: str) -> DataFrame:
    return sparql(lambda p: triples(spark, d, (p,) if p else None), text)


@query("SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def bgp_region_customers(spark, d):
    return _ask(spark, d, 'SELECT ?name (COUNT(?c) AS ?n) WHERE { ?c inNation ?k . ?c hasSegment ?s . ?k inRegion ?r . ?r hasName "ASIA" . ?k hasName ?name } GROUP BY ?name')


@query("SELECT 'part:' || p_partkey AS p, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def bgp_star_pivot(spark, d):
    """A star of patterns on one subject in a single pass: the objects are pivoted instead of joined."""
    wanted = ("hasName", "hasBrand", "hasSize")
    star = triples(spark, d, wanted).where(F.col("subject").startswith("part:"))
    pivot = star.groupBy(F.col("subject").alias("p")).agg(*(F.max(F.when(F.col("predicate") == w, F.col("object"))).alias(w[3:].lower()) for w in wanted))
    return pivot.where("name is not null and brand is not null and size is not null")


@query(f"WITH {TRIPLES_SQL} SELECT subject, predicate, object FROM t WHERE subject = 'nation:7'")
def pattern_by_subject(spark, d):
    return T.match(triples(spark, d), subject="nation:7").select(*T.KEY)


@query(f"WITH {TRIPLES_SQL} SELECT subject FROM t WHERE predicate = 'hasSegment' AND object = 'BUILDING'")
def pattern_pred_object(spark, d):
    return T.match(triples(spark, d, ("hasSegment",)), predicate="hasSegment", obj="BUILDING").select("subject")


@query(f"WITH {TRIPLES_SQL} SELECT subject, object FROM t WHERE predicate = 'placedBy' ORDER BY subject, predicate, object LIMIT 25")
def pattern_limit(spark, d):
    return T.match(triples(spark, d, ("placedBy",)), predicate="placedBy", limit=25).select("subject", "object")


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT subject FROM t WHERE predicate = 'inNation' AND object = 'nation:3'")
def distinct_subjects(spark, d):
    return T.terms(triples(spark, d, ("inNation",)), "subject", predicate="inNation", obj="nation:3")


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT predicate FROM t")
def distinct_predicates(spark, d):
    return T.terms(triples(spark, d), "predicate")


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT object FROM t WHERE predicate = 'hasBrand'")
def distinct_objects(spark, d):
    return T.terms(triples(spark, d, ("hasBrand",)), "object", predicate="hasBrand")


@query("SELECT md5('customer:' || c_custkey || '|inNation|nation:' || ((c_nationkey + 1) % 25) || '|uri') AS id, 'customer:' || c_custkey AS subject, 'nation:' || ((c_nationkey + 1) % 25) AS object FROM customer WHERE c_custkey % 2 = 0")
def triple_dedupe_md5(spark, d):
    """Insert of a batch with repeated and known triples: every second customer moves one nation on."""
    store = triples(spark, d, ("inNation",))
    customers = table(spark, d, "customer").where("c_custkey % 2 = 0")
    moved = customers.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("inNation").alias("predicate"), F.concat(F.lit("nation:"), F.expr("(c_nationkey + 1) % 25").cast("string")).alias("object"), F.lit("uri").alias("object_type"))
    return T.insert(store, moved.unionByName(moved).unionByName(store)).select("id", "subject", "object")


@query(f"WITH {TRIPLES_SQL} SELECT predicate, count(*) AS n FROM t WHERE NOT (predicate = 'hasSegment' AND object = 'BUILDING') GROUP BY 1")
def triple_remove(spark, d):
    return T.remove(triples(spark, d), predicate="hasSegment", obj="BUILDING").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) > 0 AS found FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1")
def triple_exists(spark, d):
    return T.exists(triples(spark, d, ("inRegion",)), "nation:3", "inRegion", "region:1")


@query(f"WITH {TRIPLES_SQL} SELECT predicate, count(*) AS n FROM t WHERE lower(subject || ' ' || predicate || ' ' || object) LIKE '%asia%' OR lower(subject || ' ' || predicate || ' ' || object) LIKE '%brand%' GROUP BY 1")
def keyword_pattern(spark, d):
    return T.keyword(triples(spark, d), ["asia", "brand"]).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_hits FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) AS token FROM documents) WHERE length(token) > 2 GROUP BY ALL) GROUP BY 1")
def fulltext_tokens(spark, d):
    return T.fulltext(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def temporal_index(spark, d):
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {TRIPLES_SQL} SELECT 's' AS index_name, count(DISTINCT subject) AS n_keys FROM t UNION ALL SELECT 'p', count(DISTINCT predicate) FROM t UNION ALL SELECT 'o', count(DISTINCT object) FROM t"
    " UNION ALL SELECT 'sp', count(*) FROM (SELECT DISTINCT subject, predicate FROM t) UNION ALL SELECT 'po', count(*) FROM (SELECT DISTINCT predicate, object FROM t) UNION ALL SELECT 'so', count(*) FROM (SELECT DISTINCT subject, object FROM t)"
)
def index_stats(spark, d):
    return T.index_sizes(triples(spark, d))


@query("SELECT 'part:' || p_partkey AS p, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_size >= 40 AND p_size < 45 AND (contains(p_name, 'a') OR starts_with(p_brand, 'Brand#1'))")
def sparql_filter_ops(spark, d):
    return _ask(spark, d, 'SELECT ?p ?name ?size WHERE { ?p hasSize ?size ; hasName ?name ; hasBrand ?b . FILTER(?size >= 40 && ?size < 45) FILTER(CONTAINS(?name, "a") || STRSTARTS(?b, "Brand#1")) }')


@query("SELECT 'nation:' || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 5")
def sparql_group_having(spark, d):
    return _ask(spark, d, "SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c inNation ?k . ?c hasSegment ?s } GROUP BY ?k HAVING (?n > 5)")


@query("SELECT p_brand AS b, count(*) AS n, count(DISTINCT p_size) AS sizes, CAST(sum(p_size) AS DOUBLE) AS total, avg(p_size) AS mean, CAST(min(p_size) AS VARCHAR) AS low, CAST(max(p_size) AS VARCHAR) AS high, sum(DISTINCT p_size)::DOUBLE AS apart FROM part GROUP BY 1")
def sparql_aggregates(spark, d):
    return _ask(spark, d, "SELECT ?b (COUNT(?p) AS ?n) (COUNT(DISTINCT ?s) AS ?sizes) (SUM(?s) AS ?total) (AVG(?s) AS ?mean) (MIN(?s) AS ?low) (MAX(?s) AS ?high) (SUM(DISTINCT ?s) AS ?apart) WHERE { ?p hasBrand ?b ; hasSize ?s } GROUP BY ?b")


@query("SELECT 'nation:' || n_nationkey AS k, n_name AS name, 'supplier:' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def sparql_optional(spark, d):
    return _ask(spark, d, 'SELECT ?k ?name ?s WHERE { ?k inRegion ?r . ?k hasName ?name . OPTIONAL { ?s inNation ?k . FILTER(STRSTARTS(?s, "supplier:")) } }')


@query("SELECT 'customer:' || c_custkey AS x, 'nation:' || c_nationkey AS k FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier WHERE s_nationkey < 3")
def sparql_union(spark, d):
    return _ask(spark, d, 'SELECT ?x ?k WHERE { { ?x inNation ?k . FILTER(?k = "nation:0" || ?k = "nation:1" || ?k = "nation:2") } UNION { ?x inRegion ?k } }')


@query("SELECT DISTINCT 'region:' || n_regionkey AS subject, 'hasCustomer' AS predicate, 'customer:' || c_custkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_construct(spark, d):
    return _ask(spark, d, "CONSTRUCT { ?r hasCustomer ?c } WHERE { ?c inNation ?k . ?c hasSegment ?s . ?k inRegion ?r }")


@query("SELECT DISTINCT p_brand AS b, CAST(p_size AS VARCHAR) AS s FROM part ORDER BY b DESC, s ASC LIMIT 40 OFFSET 10")
def sparql_distinct_order_slice(spark, d):
    return _ask(spark, d, "SELECT DISTINCT ?b ?s WHERE { ?p hasBrand ?b ; hasSize ?s } ORDER BY DESC(?b) ?s LIMIT 40 OFFSET 10")


@query("SELECT 'region:' || n_regionkey AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def sparql_group_concat(spark, d):
    return _ask(spark, d, 'SELECT ?r (GROUP_CONCAT(?n; separator=", ") AS ?names) WHERE { ?k inRegion ?r . ?k hasName ?n } GROUP BY ?r')


@query("SELECT count(*) > 0 AS answer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND n_name = 'FRANCE'")
def sparql_ask(spark, d):
    return _ask(spark, d, 'ASK { ?k inRegion ?r . ?r hasName "EUROPE" . ?k hasName "FRANCE" }')


_REL = "(SELECT DISTINCT relationship_id, from_id, to_id, upper(rel_type) AS rel_type, version FROM code_relationships)"


def _rel(spark, d):
    return table(spark, d, "code_relationships").select("relationship_id", "from_id", "to_id", F.upper("rel_type").alias("rel_type"), "version").distinct()


def _nodes(spark, d):
    """One row per entity: the last ingested, ties by version."""
    e = table(spark, d, "code_entities").select("entity_id", "name", "entity_type", "repository_id", "file_path", "version", "ingested_at")
    return e.groupBy("entity_id").agg(F.max_by(F.struct("name", "entity_type", "repository_id", "file_path"), F.struct("ingested_at", "version")).alias("r")).select("entity_id", "r.*")


def _types(spark, d):
    """The type of each entity, of the same rows as `_nodes`; only what is needed goes through the shuffle."""
    e = table(spark, d, "code_entities").select("entity_id", "entity_type", "version", "ingested_at")
    return e.groupBy("entity_id").agg(F.max_by("entity_type", F.struct("ingested_at", "version")).alias("entity_type"))


_NODES = "nodes AS (SELECT entity_id, name, entity_type, repository_id, file_path FROM code_entities QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at DESC, version DESC) = 1)"


@query(f"WITH {_NODES}, r AS {_REL} SELECT a.entity_type AS from_type, r.rel_type, b.entity_type AS to_type, count(*) AS n FROM r JOIN nodes a ON a.entity_id = r.from_id JOIN nodes b ON b.entity_id = r.to_id GROUP BY ALL")
def hop1_traverse(spark, d):
    nodes = _types(spark, d)
    a, b = nodes.toDF("from_id", "from_type"), nodes.toDF("to_id", "to_type")
    return _rel(spark, d).join(a, "from_id").join(b, "to_id").groupBy("from_type", "rel_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS (SELECT DISTINCT from_id, to_id FROM {_REL} WHERE rel_type IN ('IMPORTS','USES','DEPENDS_ON') AND to_id IS NOT NULL) SELECT entity_id, sum(o) AS n_dependencies, sum(i) AS n_dependents FROM (SELECT from_id AS entity_id, 1 AS o, 0 AS i FROM r UNION ALL SELECT to_id, 0, 1 FROM r) GROUP BY 1")
def deps_and_dependents(spark, d):
    edges = _rel(spark, d).where("rel_type in ('IMPORTS', 'USES', 'DEPENDS_ON') and to_id is not null").select("from_id", "to_id").distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.entity_id").agg(F.sum("e.o").alias("n_dependencies"), F.sum("e.i").alias("n_dependents"))


@query(f"WITH {_NODES} SELECT entity_id, count(*) OVER (PARTITION BY repository_id, regexp_replace(file_path, '/[^/]*$', '')) - 1 AS n_siblings FROM nodes WHERE entity_type = 'File'")
def siblings_same_group(spark, d):
    """Number of other files in the folder of each file; the pairs themselves would grow with the square of a folder."""
    files = _nodes(spark, d).where("entity_type = 'File'").withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", ""))
    sizes = files.groupBy("repository_id", "folder").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    return files.join(sizes, ["repository_id", "folder"]).select("entity_id", "n_siblings")


@query(f"WITH r AS (SELECT DISTINCT from_id, to_id FROM {_REL} WHERE rel_type = 'CONTAINS' AND to_id IS NOT NULL) SELECT from_id, count(*) AS n_children, list_sort(list(to_id)) AS children FROM r WHERE from_id LIKE 'file:%' GROUP BY 1")
def containment_collect(spark, d):
    r = _rel(spark, d).where("rel_type = 'CONTAINS' and to_id is not null and from_id like 'file:%'").select("from_id", "to_id").distinct()
    return r.groupBy("from_id").agg(F.count(F.lit(1)).alias("n_children"), F.array_sort(F.collect_list("to_id")).alias("children"))


@query(f"SELECT rel_type, count(*) AS n_dangling FROM {_REL} r WHERE to_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT entity_id FROM code_entities UNION SELECT entity_id FROM shared_modules) e WHERE e.entity_id = r.to_id) GROUP BY 1")
def dangling_edges(spark, d):
    known = table(spark, d, "code_entities").select("entity_id").unionByName(table(spark, d, "shared_modules").select("entity_id"))
    return _rel(spark, d).where("to_id is not null").join(known, F.col("to_id") == F.col("entity_id"), "left_anti").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n_dangling"))


@query("SELECT entity_type, 'name' AS property, count(*) FILTER (WHERE name IS NULL) AS n_missing, count(*) AS n FROM code_entities GROUP BY 1 UNION ALL SELECT entity_type, 'language', count(*) FILTER (WHERE language IS NULL), count(*) FROM code_entities GROUP BY 1")
def missing_required(spark, d):
    e = table(spark, d, "code_entities")
    checks = F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).isNull().cast("int").alias("gone")) for p in ("name", "language")))
    return e.select("entity_type", F.explode(checks).alias("c")).groupBy("entity_type", "c.property").agg(F.sum("c.gone").alias("n_missing"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NODES}, r AS {_REL} SELECT r.relationship_id, a.entity_type AS from_type FROM r JOIN nodes a ON a.entity_id = r.from_id JOIN nodes b ON b.entity_id = r.to_id WHERE r.rel_type IN ('EXTENDS', 'INHERITS') AND (a.entity_type <> 'Class' OR b.entity_type <> 'Class') OR r.rel_type IN ('CALLS', 'USES') AND b.entity_type NOT IN ('Method', 'Function') OR r.rel_type = 'CONTAINS' AND a.entity_type = 'Method'")
def domain_range_violations(spark, d):
    """Relationships whose ends are of a type that theirs does not have; one pass over the nodes for each end."""
    nodes = _types(spark, d)
    a, b = nodes.toDF("from_id", "from_type"), nodes.toDF("to_id", "to_type")
    wrong = "rel_type in ('EXTENDS', 'INHERITS') and (from_type <> 'Class' or to_type <> 'Class') or rel_type in ('CALLS', 'USES') and to_type not in ('Method', 'Function') or rel_type = 'CONTAINS' and from_type = 'Method'"
    return _rel(spark, d).where("rel_type in ('EXTENDS', 'INHERITS', 'CALLS', 'USES', 'CONTAINS')").join(a, "from_id").join(b, "to_id").where(wrong).select("relationship_id", "from_type")


@query("SELECT name, entity_type, count(DISTINCT entity_id) AS n_ids FROM code_entities WHERE name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT entity_id) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "code_entities").where("name is not null").groupBy("name", "entity_type").agg(F.count_distinct("entity_id").alias("n_ids")).where("n_ids > 1")


@query("SELECT entity_id, version, max(ingested_at) AS ingested_at, count(*) AS n_rows FROM code_entities GROUP BY 1, 2")
def merge_nodes(spark, d):
    """MERGE by key: one row for each (entity_id, version), the last delivery."""
    return table(spark, d, "code_entities").groupBy("entity_id", "version").agg(F.max("ingested_at").alias("ingested_at"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT DISTINCT from_id, upper(rel_type) AS rel_type, to_id, version FROM code_relationships WHERE to_id IS NOT NULL")
def merge_edges(spark, d):
    return table(spark, d, "code_relationships").where("to_id is not null").select("from_id", F.upper("rel_type").alias("rel_type"), "to_id", "version").distinct()


@query(f"WITH {_NODES}, r AS {_REL}, top AS (SELECT entity_id FROM nodes WHERE entity_type = 'Package' AND repository_id = 'repo-platform-core'), gone AS (SELECT entity_id FROM top UNION SELECT to_id FROM r JOIN top ON from_id = entity_id WHERE rel_type = 'CONTAINS' AND to_id IS NOT NULL) SELECT rel_type, count(*) AS n FROM r WHERE from_id NOT IN (SELECT entity_id FROM gone) AND (to_id IS NULL OR to_id NOT IN (SELECT entity_id FROM gone)) GROUP BY 1")
def detach_delete(spark, d):
    """Relationships that are left when packages go with all they contain."""
    top = _nodes(spark, d).where("entity_type = 'Package' and repository_id = 'repo-platform-core'").select(F.col("entity_id").alias("g"))
    inner = _rel(spark, d).where("rel_type = 'CONTAINS' and to_id is not null").join(top, F.col("from_id") == F.col("g"), "left_semi").select(F.col("to_id").alias("g"))
    gone = top.unionByName(inner).distinct()
    left = _rel(spark, d).join(gone, F.col("from_id") == F.col("g"), "left_anti").join(gone, F.col("to_id") == F.col("g"), "left_anti")
    return left.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_type, upper(coalesce(language, 'none')) AS language, count(DISTINCT entity_id) AS n_entities FROM code_entities GROUP BY ALL")
def label_counts(spark, d):
    return table(spark, d, "code_entities").groupBy("entity_type", F.upper(F.coalesce("language", F.lit("none"))).alias("language")).agg(F.count_distinct("entity_id").alias("n_entities"))


@query("SELECT k AS property, count(*) AS n FROM (SELECT unnest(map_keys(metadata)) AS k FROM code_entities) GROUP BY 1")
def property_frequency(spark, d):
    return table(spark, d, "code_entities").select(F.explode(F.map_keys("metadata")).alias("property")).groupBy("property").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NODES} SELECT entity_id, name, substr(name, 1, 8) AS preview FROM nodes WHERE entity_type IN ('Class', 'Function') AND contains(lower(name), 'snapshot') ORDER BY name NULLS LAST, entity_id LIMIT 20")
def code_search_preview(spark, d):
    hits = _nodes(spark, d).where("entity_type in ('Class', 'Function')").where(F.contains(F.lower("name"), F.lit("snapshot")))
    return hits.orderBy(F.col("name").asc_nulls_last(), "entity_id").limit(20).select("entity_id", "name", F.substring("name", 1, 8).alias("preview"))


@query("SELECT file_id, version FROM code_contexts WHERE len(list_filter(functions, lambda f: contains(lower(f.name), 'ledger') OR contains(lower(f.name), 'quota'))) > 0")
def any_term_search(spark, d):
    hit = lambda f: F.contains(F.lower(f["name"]), F.lit("ledger")) | F.contains(F.lower(f["name"]), F.lit("quota"))
    return table(spark, d, "code_contexts").where(F.exists("functions", hit)).select("file_id", "version")


@query("SELECT 'customer:' || c_custkey AS c, 'region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_path_sequence(spark, d):
    return _ask(spark, d, "SELECT ?c ?r WHERE { ?c inNation/inRegion ?r . ?c hasSegment ?s }")


@query("SELECT 'region:' || n_regionkey AS r, 'nation:' || n_nationkey AS k FROM nation")
def sparql_path_inverse(spark, d):
    return _ask(spark, d, "SELECT ?r ?k WHERE { ?r ^inRegion ?k }")


@query("SELECT x, v FROM (SELECT 'nation:' || n_nationkey AS x, n_name AS v FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation) WHERE x IN ('nation:1', 'nation:2')")
def sparql_path_alternative(spark, d):
    return _ask(spark, d, 'SELECT ?x ?v WHERE { ?x inRegion|hasName ?v . FILTER(?x IN ("nation:1", "nation:2")) }')


@query("SELECT 'nation:' || n_nationkey AS k, n_name AS name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def sparql_subquery(spark, d):
    return _ask(spark, d, "SELECT ?k ?name ?n WHERE { ?k hasName ?name . { SELECT ?k (COUNT(?c) AS ?n) WHERE { ?c inNation ?k . ?c hasSegment ?s } GROUP BY ?k } }")


@query(f"WITH {TRIPLES_SQL} SELECT subject, predicate, object FROM t WHERE subject = 'nation:3' OR object = 'nation:3'")
def sparql_describe(spark, d):
    return _ask(spark, d, "DESCRIBE <nation:3>")


_TWO_ENDS = "a AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT x.c_custkey AS f, min(y.c_custkey) AS t FROM a x JOIN a y ON x.n_regionkey = y.n_regionkey AND x.c_nationkey <> y.c_nationkey WHERE x.c_custkey = 1 GROUP BY 1)"


@query(
    f"WITH {_TWO_ENDS} SELECT i AS step, v[i] AS node FROM (SELECT ['customer:' || f, 'nation:' || x.c_nationkey, 'region:' || x.n_regionkey, 'nation:' || y.c_nationkey, 'customer:' || t] AS v FROM p JOIN a x ON x.c_custkey = f JOIN a y ON y.c_custkey = t), range(1, 6) r(i)"
)
def shortest_path(spark, d):
    """The way between two customers of a region, against the direction of the links where needed."""
    edges = triples(spark, d, ("inNation", "inRegion")).where("object_type = 'uri'").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = c.where("c_custkey = 1").first()
    other = c.where((F.col("n_regionkey") == own.n_regionkey) & (F.col("c_nationkey") != own.c_nationkey)).agg(F.min("c_custkey").alias("k")).first().k
    path = path_between(edges, "customer:1", f"customer:{other}")
    return spark.createDataFrame(list(enumerate(path or [], 1)), "step bigint, node string")


_SOURCES = "src AS (SELECT entity_id, name, entity_type, source_code FROM code_entities QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at DESC, version DESC) = 1)"


def _sources(spark, d):
    e = table(spark, d, "code_entities").select("entity_id", "name", "entity_type", "source_code", "version", "ingested_at")
    return e.groupBy("entity_id").agg(F.max_by(F.struct("name", "entity_type", "source_code"), F.struct("ingested_at", "version")).alias("r")).select("entity_id", "r.*")


@query(f"WITH {_SOURCES} SELECT entity_id, name, substr(source_code, 1, 300) AS preview FROM src WHERE entity_type IN ('Class', 'Function', 'Method') AND (contains(lower(name), 'snapshot') OR contains(lower(source_code), 'snapshot')) ORDER BY name NULLS LAST, entity_id LIMIT 50")
def code_search_source(spark, d):
    """Search in names and source text, with a preview of 300 characters; the first 50."""
    holds = lambda c: F.contains(F.lower(c), F.lit("snapshot"))
    hits = _sources(spark, d).where("entity_type in ('Class', 'Function', 'Method')").where(holds("name") | holds("source_code"))
    return hits.orderBy(F.col("name").asc_nulls_last(), "entity_id").limit(50).select("entity_id", "name", F.substring("source_code", 1, 300).alias("preview"))


@query(
    "SELECT file_id, c.version FROM code_contexts c LEFT JOIN (SELECT entity_id, version, max(source_code) AS s FROM code_entities WHERE entity_type = 'File' GROUP BY ALL) e ON e.entity_id = c.file_id AND e.version = c.version WHERE regexp_matches(lower(coalesce(s, '')), 'ledger|quota')"
    " OR len(list_filter(classes, lambda k: regexp_matches(lower(k.name), 'ledger|quota') OR len(list_filter(k.methods, lambda m: regexp_matches(lower(m), 'ledger|quota'))) > 0)) > 0 OR len(list_filter(functions, lambda k: regexp_matches(lower(k.name), 'ledger|quota'))) > 0"
)
def any_term_source(spark, d):
    """Files with any of the terms in their text, classes, methods or functions."""
    hit = lambda c: F.coalesce(F.lower(c).rlike("ledger|quota"), F.lit(False))
    named = lambda k: hit(k["name"]) | F.coalesce(F.exists(k["methods"], hit), F.lit(False))
    s = table(spark, d, "code_entities").where("entity_type = 'File'").groupBy(F.col("entity_id").alias("file_id"), "version").agg(F.max("source_code").alias("s"))
    found = hit("s") | F.coalesce(F.exists("classes", named), F.lit(False)) | F.coalesce(F.exists("functions", lambda f: hit(f["name"])), F.lit(False))
    return table(spark, d, "code_contexts").join(s, ["file_id", "version"], "left").where(found).select("file_id", "version")


@query(
    f"WITH {_NODES}, f AS (SELECT entity_id, name, file_path, split_part(entity_id, ':', 2) AS language, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM nodes WHERE entity_type = 'File' AND file_path IS NOT NULL), q AS (SELECT * FROM f ORDER BY entity_id LIMIT 1)"
    " SELECT 'exact' AS kind, f.entity_id FROM f, q WHERE f.file_path = q.file_path UNION ALL SELECT 'folder', f.entity_id FROM f, q WHERE f.folder = q.folder AND f.language = q.language AND f.entity_id <> q.entity_id"
    " UNION ALL SELECT 'query', entity_id FROM f WHERE contains(lower(file_path), 'snapshot') UNION ALL SELECT 'language', entity_id FROM (SELECT f.entity_id FROM f, q WHERE f.language = q.language ORDER BY length(f.file_path) DESC, f.entity_id LIMIT 10)"
)
def context_frames(spark, d):
    """Context of one file: itself, its folder in its language, what fits a query, and the ten of its language that rank first."""
    f = _nodes(spark, d).where("entity_type = 'File' and file_path is not null").select("entity_id", "file_path", F.split_part("entity_id", F.lit(":"), F.lit(2)).alias("language"), F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"))
    q = f.orderBy("entity_id").first()
    tagged = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "entity_id")
    near = f.where((F.col("folder") == q.folder) & (F.col("language") == q.language) & (F.col("entity_id") != q.entity_id))
    first = f.where(F.col("language") == q.language).orderBy(F.desc(F.length("file_path")), "entity_id").limit(10)
    return tagged("exact", f.where(F.col("file_path") == q.file_path)).unionByName(tagged("folder", near)).unionByName(tagged("query", f.where(F.contains(F.lower("file_path"), F.lit("snapshot"))))).unionByName(tagged("language", first))


@query(
    f"SELECT src, dst, kind, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT file_id AS src, m.module AS dst, 'imports' AS kind, greatest(1, len(m.items)) AS w FROM (SELECT file_id, unnest(imports) AS m FROM code_contexts)"
    f" UNION ALL SELECT from_id, to_id, lower(rel_type), 1 FROM {_REL} WHERE rel_type IN ('CALLS', 'EXTENDS', 'INHERITS') AND to_id IS NOT NULL) GROUP BY ALL"
)
def dependency_graph_weights(spark, d):
    """Imports weigh as many as they name, calls and inheritance one each."""
    i = table(spark, d, "code_contexts").select(F.col("file_id").alias("src"), F.explode("imports").alias("m"))
    imports = i.select("src", F.col("m.module").alias("dst"), F.lit("imports").alias("kind"), F.greatest(F.lit(1), F.size("m.items")).alias("w"))
    rest = _rel(spark, d).where("rel_type in ('CALLS', 'EXTENDS', 'INHERITS') and to_id is not null").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lower("rel_type").alias("kind"), F.lit(1).alias("w"))
    return imports.unionByName(rest).groupBy("src", "dst", "kind").agg(F.sum("w").cast("bigint").alias("weight"))


_BETWEEN = "m AS (SELECT entity_id, regexp_replace(file_path, '/[^/]*$', '') AS module FROM nodes WHERE file_path IS NOT NULL), b AS (SELECT DISTINCT x.module AS src, y.module AS dst FROM r JOIN m x ON x.entity_id = r.from_id JOIN m y ON y.entity_id = r.to_id WHERE r.rel_type IN ('IMPORTS', 'CALLS', 'USES', 'DEPENDS_ON') AND x.module <> y.module)"


@query(f"WITH RECURSIVE {_NODES}, r AS {_REL}, {_BETWEEN}, c AS (SELECT src AS s, dst AS n FROM b UNION SELECT c.s, b.dst FROM c JOIN b ON b.src = c.n) SELECT src, dst, EXISTS (SELECT 1 FROM c WHERE c.s = b.dst AND c.n = b.src) AS circular FROM b")
def module_dependencies(spark, d):
    """Dependencies between folders; circular ones lie within a strongly connected part."""
    nodes = _nodes(spark, d).where("file_path is not null").select("entity_id", F.regexp_replace("file_path", "/[^/]*$", ""))
    a, b = nodes.toDF("from_id", "src"), nodes.toDF("to_id", "dst")
    r = _rel(spark, d).where("rel_type in ('IMPORTS', 'CALLS', 'USES', 'DEPENDS_ON')").join(a, "from_id").join(b, "to_id").where("src <> dst").select("src", "dst").distinct()
    parts = strong_parts(r.select(F.col("dst").alias("child"), F.col("src").alias("parent")))
    x, y = parts.toDF("src", "p"), parts.toDF("dst", "q")
    return r.join(x, "src", "left").join(y, "dst", "left").select("src", "dst", F.coalesce(F.col("p") == F.col("q"), F.lit(False)).alias("circular"))


@query(f"WITH {_NODES}, f AS (SELECT entity_id, repository_id, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM nodes WHERE entity_type = 'File' AND file_path IS NOT NULL), q AS (SELECT * FROM f ORDER BY entity_id LIMIT 1) SELECT f.entity_id FROM f, q WHERE f.repository_id = q.repository_id AND f.folder = q.folder AND f.entity_id <> q.entity_id")
def siblings_of_file(spark, d):
    """The other files in the folder of one file."""
    f = _nodes(spark, d).where("entity_type = 'File' and file_path is not null").select("entity_id", "repository_id", F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"))
    q = f.orderBy("entity_id").first()
    return f.where((F.col("repository_id") == q.repository_id) & (F.col("folder") == q.folder) & (F.col("entity_id") != q.entity_id)).select("entity_id")


@query("SELECT 'customer:' || c_custkey AS subject, 'PART_OF' AS edge_type, 'nation:' || c_nationkey AS value FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'hasSegment', c_mktsegment FROM customer UNION ALL SELECT 'customer:' || c_custkey, 'hasName', c_name FROM customer")
def module_sync(spark, d):
    """Triples of customers as edges and properties, and both as rows again."""
    store = triples(spark, d, ("inNation", "hasName", "hasSegment")).where("subject like 'customer:%'")
    links, properties = T.routed(store, {"inNation": "PART_OF"})
    return links.select("subject", "edge_type", F.col("target").alias("value")).unionByName(properties.select("subject", F.explode("properties").alias("edge_type", "value")))
