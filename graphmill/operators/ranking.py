"""Ranking, top-k, token budgets, eviction and retention, as windows and ordered folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """The first k rows, of each group if `by` is given."""
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


#: Parts of a group that are summed apart, before the few rows that may fit are summed together.
PARTS = 32


def _first(df: DataFrame, group: str, tokens: str, budget: int, before: bool, order: tuple[Column, ...]) -> DataFrame:
    """Rows that may lie within the budget: what comes before a row in one part of its group already counts, so that a row
    over the budget in its part is over it in the group. A large group is split by a hash of the whole row."""
    part = F.pmod(F.xxhash64(*(f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant"))), F.lit(PARTS))
    run = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = df.withColumn("_part", part).withColumn("_sum", F.coalesce(F.sum(tokens).over(run), F.lit(0)))
    return own.where(F.col("_sum") < budget if before else F.col("_sum") <= budget).drop("_part", "_sum")


def budget_prefix(df: DataFrame, group: str, tokens: str, budget: int, *order: Column) -> DataFrame:
    """Items in order until the budget of their group would be exceeded: nothing after the first overflow."""
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _first(df, group, tokens, budget, False, order).withColumn("used_tokens", F.sum(tokens).over(run)).where(F.col("used_tokens") <= budget)


def budget_overshoot(df: DataFrame, group: str, tokens: str, budget: int, *order: Column) -> DataFrame:
    """Items in order until the budget is reached; the last may overshoot it."""
    run = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return _first(df, group, tokens, budget, True, order).withColumn("before", F.coalesce(F.sum(tokens).over(run), F.lit(0))).where(F.col("before") < budget).drop("before")


def budget_fold(df: DataFrame, group: str, key: str, tokens: str, score: str, budget: int, truncate: int | None = None) -> DataFrame:
    """Ordered fold over all items of a group, best score first: items that do not fit are skipped, or the first of them is
    cut if more than `truncate` tokens remain, which ends the fold.

    Columns: the group, `key`, `taken` (tokens of the item that are used). Rows come sorted by group and score and stream
    through the fold, which keeps the room of one group only; ties go to the lower key. Without `truncate` items larger
    than the whole budget are left out before the shuffle, since they fit nowhere.
    """
    items = df.select(F.col(group).cast("string").alias("g"), F.col(key).cast("bigint").alias("k"), F.col(tokens).cast("bigint").alias("t"), F.col(score).alias("s"))
    if truncate is None:
        items = items.where(F.col("t") <= budget)
    ordered = items.repartition("g").sortWithinPartitions("g", F.desc("s"), "k").select("g", "k", "t")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, room, over = object(), 0, False
        for batch in batches:
            out: list[tuple] = []
            for g, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != last:
                    last, room, over = g, budget, False
                if over or t is None:
                    continue
                taken = t if t <= room else room if truncate is not None and room > truncate else None
                over = truncate is not None and t > room
                if taken is not None:
                    room -= taken
                    out.append((g, k, taken))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["g", "k", "taken"])

    return ordered.mapInArrow(fold, "g string, k bigint, taken bigint").select(F.col("g").alias(group), F.col("k").alias(key), "taken")


def keep_last(df: DataFrame, group: str, n: int, *newest_first: Column) -> DataFrame:
    return top_k(df, n, *newest_first, by=[group])


def first_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Dedup: the first row of each key."""
    return top_k(df, 1, *order, by=[key])
