"""Registered queries of problems 6 and 7: hierarchies of CONTAINS rows and orphan references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import references as R
from ..session import table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_relationships").where("upper(rel_type) = 'CONTAINS'")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.cyclic_members(H.clean_links(_contains(spark, d), "to_id", "from_id")).select(F.col("member").alias("entity_id"))


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    full = H.with_descendant_counts(H.hierarchy(_contains(spark, d), "to_id", "from_id"))
    return full.select("node_id", "parent_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "status", "n_descendants")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_contains(spark, d), "to_id", "from_id"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "code_relationships"), table(spark, d, "code_entities"), table(spark, d, "shared_modules")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_relationships(*_tables(spark, d)).select("relationship_id", "side").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(*_tables(spark, d))


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """References of the other tables, by table, column and month."""
    entities, contexts = table(spark, d, "code_entities"), table(spark, d, "code_contexts")
    repositories = table(spark, d, "repositories").select(F.col("repository_id").alias("key"))
    files, known = entities.where("entity_type = 'File'").select(F.col("entity_id").alias("key")), contexts.select(F.col("file_id").alias("key"))
    checks = (
        (contexts, "code_contexts", "file_id", "last_modified", files), (table(spark, d, "method_knowledge").withColumn("at", F.lit(None).cast("timestamp_ntz")), "method_knowledge", "file_id", "at", known),
        (entities, "code_entities", "repository_id", "ingested_at", repositories), (table(spark, d, "documents"), "documents", "source", "ingested_at", repositories),
    )
    return reduce(DataFrame.unionByName, (R.missing_keys(*check) for check in checks))


QUERIES = {"p7_tables": p7_tables, "p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_descendants": p6_descendants, "p7_found": p7_found, "p7_report": p7_report}

_EDGES = """
edges AS (SELECT DISTINCT from_id AS parent, to_id AS child FROM code_relationships
          WHERE upper(rel_type) = 'CONTAINS' AND from_id IS NOT NULL AND to_id IS NOT NULL),
climb AS (SELECT child AS start, parent AS above FROM edges
          UNION SELECT c.start, e.parent FROM climb c JOIN edges e ON e.child = c.above),
cyc AS (SELECT DISTINCT start AS node FROM climb WHERE start = above)
"""
_TREE = _EDGES + """,
tree AS (SELECT DISTINCT parent AS node, CAST(NULL AS VARCHAR) AS parent, parent AS root, 0 AS depth, parent AS path FROM edges
         WHERE parent NOT IN (SELECT child FROM edges)
         UNION ALL SELECT e.child, e.parent, t.root, t.depth + 1, t.path || ' > ' || e.child FROM tree t JOIN edges e ON e.parent = t.node)
"""
_ORPHANS = """
refs AS (SELECT relationship_id, upper(rel_type) AS rel_type, 'from' AS side, from_id AS k, ingested_at AS at_time FROM code_relationships WHERE from_id IS NOT NULL
         UNION ALL SELECT relationship_id, upper(rel_type), 'to', to_id, ingested_at FROM code_relationships WHERE to_id IS NOT NULL),
flagged AS (SELECT r.*, k NOT IN (SELECT entity_id FROM shared_modules)
   AND NOT EXISTS (SELECT 1 FROM code_entities e WHERE e.entity_id = r.k AND e.ingested_at <= r.at_time AND (e.deleted_at IS NULL OR e.deleted_at > r.at_time)) AS gone
   FROM (SELECT DISTINCT * FROM refs) r)
"""
SQL = {
    "p6_found": f"WITH RECURSIVE {_EDGES} SELECT node AS entity_id FROM cyc",
    "p6_hierarchy": f"""WITH RECURSIVE {_TREE},
        kids AS (SELECT above AS node, count(*) AS n FROM climb WHERE start IN (SELECT node FROM tree) GROUP BY above)
        SELECT a.node AS node_id, e.parent AS parent_id, t.root AS root_id, t.depth, t.path,
          CASE WHEN t.node IS NOT NULL THEN 'tree' WHEN a.node IN (SELECT node FROM cyc) THEN 'cycle' ELSE 'below_cycle' END AS status,
          CASE WHEN t.node IS NULL THEN 0 ELSE coalesce(k.n, 0) END AS n_descendants
        FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges) a LEFT JOIN edges e ON e.child = a.node
        LEFT JOIN tree t ON t.node = a.node LEFT JOIN kids k ON k.node = a.node""",
    "p6_descendants": f"""WITH RECURSIVE {_TREE},
        down AS (SELECT parent AS ancestor_id, child AS descendant_id, 1 AS distance FROM edges WHERE child IN (SELECT node FROM tree)
                 UNION ALL SELECT d.ancestor_id, e.child, d.distance + 1 FROM down d JOIN edges e ON e.parent = d.descendant_id)
        SELECT ancestor_id, descendant_id, distance FROM down""",
    "p7_found": f"WITH {_ORPHANS} SELECT DISTINCT relationship_id, side FROM flagged WHERE gone",
    "p7_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {p} AS period, count(*) AS n_references, count(*) FILTER (WHERE {c} NOT IN (SELECT {k} FROM {o})) AS n_orphans FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"
        for t, c, p, k, o in (
            ("code_contexts", "file_id", "strftime(last_modified, '%Y-%m')", "entity_id", "code_entities WHERE entity_type = 'File'"), ("method_knowledge", "file_id", "CAST(NULL AS VARCHAR)", "file_id", "code_contexts"),
            ("code_entities", "repository_id", "strftime(ingested_at, '%Y-%m')", "repository_id", "repositories"), ("documents", "source", "strftime(ingested_at, '%Y-%m')", "repository_id", "repositories"),
        )
    ),
    "p7_report": f"""WITH {_ORPHANS} SELECT 'code_relationships' AS table_name, rel_type, side, strftime(at_time, '%Y-%m') AS period, count(*) AS n_references,
        count(*) FILTER (WHERE gone) AS n_orphans FROM flagged GROUP BY ALL""",
}
