"""The star-schema tables seen as a graph: triples, nodes and edges.

Every frame is a projection of its table, so that filters on predicates and ids reach the Parquet scans they come
from and a pattern with a bound predicate reads one table only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def uri(prefix: str, *keys: str) -> Column:
    """`prefix:key` or `prefix:key-key` as a string."""
    return F.concat(F.lit(prefix + ":"), F.concat_ws("-", *(F.col(k).cast("string") for k in keys)))


#: (predicate, table, subject, object, object type)
LINKS = (
    ("inRegion", "nation", lambda: uri("nation", "n_nationkey"), lambda: uri("region", "n_regionkey"), "uri"),
    ("inNation", "customer", lambda: uri("customer", "c_custkey"), lambda: uri("nation", "c_nationkey"), "uri"),
    ("inNation", "supplier", lambda: uri("supplier", "s_suppkey"), lambda: uri("nation", "s_nationkey"), "uri"),
    ("placedBy", "orders", lambda: uri("order", "o_orderkey"), lambda: uri("customer", "o_custkey"), "uri"),
    ("ofPart", "lineitem", lambda: uri("line", "l_orderkey", "l_linenumber"), lambda: uri("part", "l_partkey"), "uri"),
    ("fromSupplier", "lineitem", lambda: uri("line", "l_orderkey", "l_linenumber"), lambda: uri("supplier", "l_suppkey"), "uri"),
    ("hasName", "region", lambda: uri("region", "r_regionkey"), lambda: F.col("r_name"), "literal"),
    ("hasName", "nation", lambda: uri("nation", "n_nationkey"), lambda: F.col("n_name"), "literal"),
    ("hasName", "customer", lambda: uri("customer", "c_custkey"), lambda: F.col("c_name"), "literal"),
    ("hasName", "supplier", lambda: uri("supplier", "s_suppkey"), lambda: F.col("s_name"), "literal"),
    ("hasName", "part", lambda: uri("part", "p_partkey"), lambda: F.col("p_name"), "literal"),
    ("hasSegment", "customer", lambda: uri("customer", "c_custkey"), lambda: F.col("c_mktsegment"), "literal"),
    ("hasStatus", "orders", lambda: uri("order", "o_orderkey"), lambda: F.col("o_orderstatus"), "literal"),
    ("hasPriority", "orders", lambda: uri("order", "o_orderkey"), lambda: F.col("o_orderpriority"), "literal"),
    ("hasBrand", "part", lambda: uri("part", "p_partkey"), lambda: F.col("p_brand"), "literal"),
    ("hasSize", "part", lambda: uri("part", "p_partkey"), lambda: F.col("p_size").cast("string"), "literal"),
)


def triples(spark: SparkSession, d: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """`subject, predicate, object, object_type`; with `predicates` only the tables that can hold them are read."""
    parts = [
        table(spark, d, source).select(s().alias("subject"), F.lit(p).alias("predicate"), o().alias("object"), F.lit(kind).alias("object_type"))
        for p, source, s, o, kind in LINKS
        if predicates is None or p in predicates
    ]
    return reduce(DataFrame.unionByName, parts)


#: The same triples for DuckDB.
_KEYS = {
    "region": "'region:' || r_regionkey", "nation": "'nation:' || n_nationkey", "customer": "'customer:' || c_custkey", "supplier": "'supplier:' || s_suppkey", "orders": "'order:' || o_orderkey",
    "lineitem": "'line:' || l_orderkey || '-' || l_linenumber", "part": "'part:' || p_partkey",
}
_OBJECTS = {
    ("inRegion", "nation"): "'region:' || n_regionkey", ("inNation", "customer"): "'nation:' || c_nationkey", ("inNation", "supplier"): "'nation:' || s_nationkey", ("placedBy", "orders"): "'customer:' || o_custkey",
    ("ofPart", "lineitem"): "'part:' || l_partkey", ("fromSupplier", "lineitem"): "'supplier:' || l_suppkey", ("hasName", "region"): "r_name", ("hasName", "nation"): "n_name", ("hasName", "customer"): "c_name",
    ("hasName", "supplier"): "s_name", ("hasName", "part"): "p_name", ("hasSegment", "customer"): "c_mktsegment", ("hasStatus", "orders"): "o_orderstatus", ("hasPriority", "orders"): "o_orderpriority",
    ("hasBrand", "part"): "p_brand", ("hasSize", "part"): "CAST(p_size AS VARCHAR)",
}
TRIPLES_SQL = "t AS (" + " UNION ALL ".join(
    f"SELECT {_KEYS[source]} AS subject, '{p}' AS predicate, {_OBJECTS[p, source]} AS object, '{kind}' AS object_type FROM {source}" for p, source, _, _, kind in LINKS
) + ")"
