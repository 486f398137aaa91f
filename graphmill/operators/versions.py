"""Versions, differences, synchronisation and routing advice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Key and `change` (created, deleted, updated, unchanged) of two states with the same columns."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, row_hash(rest).alias("a"))
    b = new.select(*key, row_hash(rest).alias("b"))
    change = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def apply(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The state after an upsert: rows of `new`, and those of `old` whose key is not among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def sync_counts(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """How many rows a synchronisation inserts, updates, deletes and leaves."""
    return diff(target, source, key).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def resolve(source: DataFrame, target: DataFrame, key: str, strategy: str, ts: str) -> DataFrame:
    """One row per key of two states: source_wins, target_wins, last_write_wins or merge (source first, then target, by column)."""
    columns = [c for c in source.columns if c != key]
    s = source.select(key, *(F.col(c).alias(f"s_{c}") for c in columns), F.lit(True).alias("in_s"))
    t = target.select(key, *(F.col(c).alias(f"t_{c}") for c in columns), F.lit(True).alias("in_t"))
    both = s.join(t, key, "full_outer")
    if strategy == "merge":
        return both.select(key, *(F.coalesce(f"s_{c}", f"t_{c}").alias(c) for c in columns))
    first = {
        "source_wins": F.col("in_s").isNotNull(), "target_wins": F.col("in_t").isNull(), "last_write_wins": F.col("in_t").isNull() | (F.col(f"s_{ts}") >= F.col(f"t_{ts}")),
    }[strategy]
    return both.select(key, *(F.when(first, F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c) for c in columns))


def query_complexity(text: Column) -> Column:
    """low, medium or high by the operators of a query text."""
    up = F.upper(text)
    hits = lambda word, weight: F.regexp_count(up, F.lit(word)) * weight
    score = reduce(lambda a, b: a + b, (hits(r"\bUNION\b", 2), hits(r"\bOPTIONAL\b", 1), hits(r"\bFILTER\b", 1), hits(r"\bGROUP BY\b", 2), hits(r"\bORDER BY\b", 1), F.when(F.regexp_count(up, F.lit(r"\{")) > 2, 1).otherwise(0)))
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def cacheable(text: Column) -> Column:
    """Whether a query's result may be kept: no clock and no random value in it."""
    return ~F.lower(text).rlike(r"\b(?:now|rand|timestamp|current_time)\b\s*\(?")


def job_states(events: DataFrame, key: str, most_tries: int = 3) -> DataFrame:
    """State of each job from its `started`, `failed` and `done` events: done, retry or dropped, with the tries."""
    n = events.groupBy(key).agg(F.count_if(F.col("event") == "failed").alias("failures"), F.max(F.when(F.col("event") == "done", 1)).alias("done"))
    state = F.when(F.col("done") == 1, "done").when(F.col("failures") >= most_tries, "dropped").when(F.col("failures") > 0, "retry").otherwise("running")
    return n.select(key, "failures", state.alias("state"))


def schema_summary(nodes: DataFrame, edges: DataFrame, label: str, top: int = 5) -> DataFrame:
    """Relationship types with their most frequent pairs of endpoint labels: `rel_type, from_label, to_label, n, rank`."""
    from pyspark.sql import Window

    a = nodes.select(F.col("id").alias("src"), F.col(label).alias("from_label"))
    b = nodes.select(F.col("id").alias("dst"), F.col(label).alias("to_label"))
    pairs = edges.join(a, "src").join(b, "dst").groupBy("rel_type", "from_label", "to_label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("rel_type").orderBy(F.desc("n"), "from_label", "to_label")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
