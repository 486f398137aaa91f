"""Versions, incremental updates, caches and retention as keyed operations on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_id(repository: Column, commit: Column) -> Column:
    return F.concat(repository, F.lit("-"), F.substring(commit, 1, 8))


def create_versions(known: DataFrame, new: DataFrame) -> DataFrame:
    """The new versions (`repository_id, commit_hash, ...`) whose id is not known, each once with its `version_id`; a second call adds none."""
    made = new.withColumn("version_id", version_id(F.col("repository_id"), F.col("commit_hash"))).dropDuplicates(["version_id"])
    return made.join(known.select("version_id"), "version_id", "left_anti")


def page(rows: DataFrame, condition: Column, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.where(condition).orderBy(*order).offset(offset).limit(limit)


def rollback(rows: DataFrame, current: str, target: str, key: str, version: str = "version") -> DataFrame:
    """What a return from one version to another does: `key, step` (restore, remove, keep) of all rows of both."""
    old = rows.where(F.col(version) == target).select(key).distinct().withColumn("in_old", F.lit(True))
    now = rows.where(F.col(version) == current).select(key).distinct().withColumn("in_now", F.lit(True))
    step = F.when(F.col("in_now").isNull(), "restore").when(F.col("in_old").isNull(), "remove").otherwise("keep")
    return old.join(now, key, "full_outer").select(key, step.alias("step"))


def incremental(state: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The state after an analysis of the changed keys alone: their fresh rows, and the old rows of all other keys.

    A changed key without fresh rows is gone.
    """
    keys = changed.select(key).distinct()
    return fresh.join(keys, key, "left_semi").select(*state.columns).unionByName(state.join(keys, key, "left_anti"))


def merge_module(state: DataFrame, update: DataFrame, key: str, replace: bool) -> DataFrame:
    """The state after an update of modules: replaced as a whole, or merged column by column, where a null keeps the old value."""
    if replace:
        return update.select(*state.columns).unionByName(state.join(update.select(key), key, "left_anti"))
    new = update.select(key, *(F.col(c).alias(f"new_{c}") for c in state.columns if c != key))
    return state.join(new, key, "full_outer").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in state.columns if c != key))


def invalidated(cache: DataFrame, mutations: DataFrame, key: str, entry: str) -> DataFrame:
    """Keys of the cache rows whose entry names a mutated subject (`word`), found by whole words and a join, not by all pairs."""
    words = cache.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(entry), F.lit(r"[a-z0-9_:]+"), F.lit(0)))).alias("word"))
    return words.join(mutations.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select(key).distinct()


def evict_share(rows: DataFrame, share: float, *oldest_first: Column) -> DataFrame:
    """The given share of the rows, rounded up, oldest first."""
    n = rows.count()
    return rows.orderBy(*oldest_first).limit(-int(-n * share // 1))


def keep_within(rows: DataFrame, size: str, at: str, key: str, part: float) -> DataFrame:
    """The newest rows whose sizes add up to at most a part of the whole; ties go to the lower key.

    Whole days are summed first, so that only the sums of the days are in one window and the rows in one a day.
    """
    cap = rows.agg(F.sum(size) * part).first()[0] or 0
    day = F.to_date(at)
    days = rows.groupBy(day.alias("day")).agg(F.sum(size).alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") <= cap)
    run = Window.partitionBy("day").orderBy(F.desc(at), key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("day", day).join(before.select("day", "before"), "day").withColumn("used", F.col("before") + F.sum(size).over(run)).where(F.col("used") <= cap).drop("day", "before")


def keep_backups(copies: DataFrame, key: str, at: str, n: int, since: Column) -> DataFrame:
    """The newest n copies of each key that are not older than `since`."""
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    return copies.where(F.col(at) >= since).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
