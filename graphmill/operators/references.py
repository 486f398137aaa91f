"""References to records that do not exist, at the time the reference came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this share of all references is joined in SALTS parts; at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 0.002
SALTS = 32


def living_spans(entities: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Spans `key, alive_from, alive_to` in which some row of the key was live.

    Rows that end at the same time keep the earliest start and rows that start together keep the latest end, both
    before anything is shuffled, so that a key delivered very often is still a few rows.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    rows = entities.select(F.col(key).alias("key"), F.col(since).alias("a"), F.coalesce(F.col(until), far).alias("b")).where("key is not null and a < b")
    by_end = rows.groupBy("key", "b").agg(F.min("a").alias("a"))
    return by_end.groupBy("key", "a").agg(F.max("b").alias("b")).select("key", F.col("a").alias("alive_from"), F.col("b").alias("alive_to"))


def orphans(
    refs: DataFrame, spans: DataFrame, always: DataFrame | None = None
) -> DataFrame:
    """Left anti-join of the distinct references `key, at` against the spans of `living_spans`.

    `always` (`key`) holds keys that exist at any time. A null key is no reference; a null time matches only
    `always`. The result has distinct `key, at`. Keys with a large share of the references are salted: the
    references spread over SALTS parts and the few spans of those keys are repeated for each.
    """
    distinct = refs.select("key", "at").where("key is not null").distinct()
    if always is not None:
        distinct = distinct.join(always.select("key").distinct(), "key", "left_anti")
    total = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    every = total.agg(F.sum("n").alias("all_rows"))
    hot = total.crossJoin(F.broadcast(every)).where(F.col("n") > F.greatest(F.col("all_rows") * HOT_SHARE, F.lit(10_000.0))).select("key", F.lit(True).alias("is_hot"))
    salted = distinct.join(F.broadcast(hot), "key", "left").withColumn(
        "salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(0)
    )
    spread = spans.join(F.broadcast(hot), "key", "left").withColumn(
        "salt", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    found = salted.alias("r").join(
        spread.alias("s"),
        (F.col("r.key") == F.col("s.key")) & (F.col("r.salt") == F.col("s.salt")) & (F.col("s.alive_from") <= F.col("r.at")) & (F.col("r.at") < F.col("s.alive_to")),
        "left_anti",
    )
    return found.select("key", "at")


def relationship_references(rel: DataFrame) -> DataFrame:
    """Both ends of each relationship as rows `relationship_id, rel_type, side, key, at`; null ends are no references."""
    return rel.select(
        "relationship_id", F.upper("rel_type").alias("rel_type"), F.col("ingested_at").alias("at"),
        F.explode(F.array(
            F.struct(F.lit("from").alias("side"), F.col("from_id").alias("key")), F.struct(F.lit("to").alias("side"), F.col("to_id").alias("key"))
        )).alias("ref"),
    ).select("relationship_id", "rel_type", "at", "ref.side", "ref.key").where("key is not null")


def _same() -> Column:
    """The same key at the same time, where no time is the same as no time."""
    return (F.col("r.key") == F.col("m.key")) & F.col("r.at").eqNullSafe(F.col("m.at"))


def orphan_relationships(rel: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """References of relationships to entities that were not there when the row came in.

    Columns `relationship_id, rel_type, side, key, at`, one row per delivery. Duplicate rows keep their duplicates
    here; callers take what they need distinct.
    """
    refs = relationship_references(rel)
    missing = orphans(refs, living_spans(entities, "entity_id", "ingested_at", "deleted_at"), shared.select(F.col("entity_id").alias("key")))
    return refs.alias("r").join(missing.alias("m"), _same(), "left_semi")


def orphan_report(rel: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """Orphans per table, side, relationship type and month against all distinct references of that group."""
    refs = relationship_references(rel).select("relationship_id", "rel_type", "side", "key", "at").distinct()
    missing = orphans(refs, living_spans(entities, "entity_id", "ingested_at", "deleted_at"), shared.select(F.col("entity_id").alias("key")))
    flagged = refs.alias("r").join(missing.withColumn("gone", F.lit(1)).alias("m"), _same(), "left")
    return flagged.groupBy(F.lit("code_relationships").alias("table_name"), "rel_type", "side", F.date_format(F.col("r.at"), "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("n_references"), F.count("gone").alias("n_orphans")
    )


def missing_keys(rows: DataFrame, name: str, column: str, at: str, parents: DataFrame) -> DataFrame:
    """References of one column to keys that no row of `parents` (`key`) has, whatever the time.

    `table_name, column_name, period, n_references, n_orphans` by month of `at`; null keys are no references, a null time
    is a period of its own. References are counted by key and month before anything is joined, so that a key with a third
    of all rows is a few rows.
    """
    refs = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"), F.date_format(at, "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    known = parents.select("key").distinct().withColumn("there", F.lit(True))
    return refs.join(known, "key", "left").groupBy(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "period").agg(
        F.sum("n").alias("n_references"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans")
    )
