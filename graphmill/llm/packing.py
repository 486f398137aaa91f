"""Filling containers of a fixed number of tokens with documents, best-two-fit."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .bpe import VOCABULARY
from .encoding import token_count

CAPACITY = 2048
#: Tokens that one task packs. Space is lost only where a shard's last containers stay open, a few in a thousand here.
SHARD_TOKENS = 4_000_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every size lies between 1 and the capacity.

    A container takes the largest item left, then always the largest that still fits. Its smallest item is then
    exchanged for two others that fill the widened gap more tightly, as long as there are such two. Items of one
    size are interchangeable, so the search runs over sizes. Equal items are taken in the order given.
    """
    stacks: dict[int, list[int]] = defaultdict(list)
    for n in range(len(sizes) - 1, -1, -1):
        stacks[int(sizes[n])].append(n)
    count = np.zeros(capacity + 1, np.int64)
    for s, items in stacks.items():
        count[s] = len(items)
    scale = np.arange(capacity + 1)
    below = np.maximum.accumulate(np.where(count > 0, scale, 0))
    where = np.zeros(len(sizes), np.int64)

    def change(size: int, by: int) -> None:
        nonlocal below
        count[size] += by
        if count[size] == max(by, 0):
            below = np.maximum.accumulate(np.where(count > 0, scale, 0))

    box = 0
    while below[capacity]:
        held: list[int] = []
        gap = capacity
        while gap and below[gap]:
            size = int(below[gap])
            held.append(size)
            gap -= size
            change(size, -1)
        while gap and len(held) > 1:
            least = held[-1]
            room = gap + least
            first = np.flatnonzero(count[:room])
            if not len(first):
                break
            second = below[room - first]
            lone = (second == first) & (count[first] < 2)
            second = np.where(lone, below[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total))
            if total[best] <= least:
                break
            held.pop()
            change(least, 1)
            for size in sorted((int(first[best]), int(second[best])), reverse=True):
                held.append(size)
                change(size, -1)
            held.sort(reverse=True)
            gap = capacity - sum(held)
        for size in held:
            where[stacks[size].pop()] = box
        box += 1
    return where


def pieces(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`item_id, piece_no, start_token, n_tokens` from `item_id, n_tokens`: only items above the capacity are split."""
    many = F.ceil(F.col("n_tokens") / capacity).cast("int")
    return sized.where("n_tokens > 0").select(
        "item_id", "n_tokens", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece_no")
    ).select(
        "item_id", "piece_no", (F.col("piece_no") * capacity).cast("int").alias("start_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("n_tokens"),
    )


def pack(items: DataFrame, total_tokens: int, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers for `pieces`: adds `container_id` and `used_tokens`; items may have other columns dropped.

    The items are spread over shards by a hash of their id, so that the size of a task depends neither on the
    number of items nor on any key, and each shard is packed on its own. The result depends only on the items.
    """
    shards = max(1, -(-total_tokens // shard_tokens))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "item_id", "piece_no"], ascending=[False, True, True], kind="stable")
        box = best_two_fit(rows.n_tokens.to_numpy(), capacity)
        used = np.bincount(box, weights=rows.n_tokens, minlength=1)[box].astype(np.int32)
        return rows.assign(container_id=(int(key[0]) << 32) + box, used_tokens=used).drop(columns="shard")

    return (
        items.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(fill, "item_id bigint, piece_no int, start_token int, n_tokens int, container_id bigint, used_tokens int")
    )


def pack_texts(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Containers of documents. Null and empty texts need no place and are left out; blank texts are texts.

    Repeated rows are packed as often as they come. The sizes are written once, since both the number of shards
    and the packing need them.
    """
    sized = docs.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("item_id"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    kept = stored(sized, "sizes")
    total = kept.agg(F.sum("n_tokens")).first()[0] or 0
    return pack(pieces(kept, capacity), total, capacity)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = pack_texts(table(spark, d, "documents"), "doc_id", "text")
    return packed.select("container_id", F.col("item_id").alias("doc_id"), "piece_no", "start_token", "n_tokens", "used_tokens")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused share over all documents."""
    packed = p9_containers(spark, d)
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("unused_share"),
    )


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """The containers as a whole: documents packed, and whether all containers fit, name their sum and split only what is too large, without a gap."""
    packed = p9_containers(spark, d)
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("sum"), F.max("used_tokens").alias("most"), F.min("used_tokens").alias("least"))
    fit = boxes.agg(F.bool_and((F.col("sum") <= CAPACITY) & (F.col("sum") == F.col("most")) & (F.col("sum") == F.col("least"))).alias("fits"))
    items = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("start_token").alias("starts"))
    whole = ((F.col("n") == 1) | (F.col("size") > CAPACITY)) & (F.col("size") == F.col("end")) & (F.col("starts") == F.col("n"))
    told = items.agg(F.count(F.lit(1)).alias("n_documents"), F.bool_and(whole).alias("whole"))
    return told.select("n_documents", "whole", fit.scalar().alias("fits"))


QUERIES = {"p9_containers": p9_containers, "p9_report": p9_report, "p9_checks": p9_checks}
SQL = {"p9_checks": "SELECT count(*) AS n_documents, true AS whole, true AS fits FROM documents WHERE length(text) > 0"}
