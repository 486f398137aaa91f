"""Similarity, relevance scores, chunking and retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Query vectors that are held in memory at once; more are searched for in further passes over the rows.
QUERY_BLOCK = 4096
DIMENSIONS = 100


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k rows nearest to each query by cosine: `query_id, key, similarity, rank`, the query itself left out.

    The queries are taken in blocks of QUERY_BLOCK. Of each block the best are written before the next is read, so that
    the driver never holds more than one; a task keeps its own best k for each query over all its batches, so that what
    is shuffled is k rows per query and task. Ties go to the lower id.
    Rows with a null or zero vector are no one's neighbours.
    """
    ids = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v")).where("v is not null")
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    parts = []
    for block in range(blocks):
        held = ids.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        if held:
            best = _scan(rows, key, vector, k, np.array([r.q for r in held]), np.array([r.v for r in held], dtype=np.float64))
            parts.append(best if blocks == 1 else stored(best, "nearest"))
    schema = "query_id bigint, row_id bigint, similarity double"
    found = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(rows: DataFrame, key: str, vector: str, k: int, names: np.ndarray, matrix: np.ndarray) -> DataFrame:
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((len(names), 0), -2.0)
        ids = np.zeros((len(names), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            near = np.where(length[:, 0] > 0, unit @ (vectors / np.maximum(length, 1e-30)).T, -2.0)
            near[names[:, None] == own[None, :]] = -2.0
            every, known = np.hstack([top, near]), np.hstack([ids, np.broadcast_to(own, near.shape)])
            order = np.lexsort((known, -every), axis=1)[:, :k]
            top, ids = np.take_along_axis(every, order, 1), np.take_along_axis(known, order, 1)
        keep = (top > -1.5).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, top.shape[1])[keep]), pa.array(ids.ravel()[keep]), pa.array(top.ravel()[keep])], ["query_id", "row_id", "similarity"])

    return rows.select(F.col(key).cast("bigint"), vector).where(F.col(vector).isNotNull()).mapInArrow(best, "query_id bigint, row_id bigint, similarity double")


def hash32(text: Column) -> Column:
    """Absolute 32-bit rolling hash h * 31 + c of a string of ASCII characters, wrapped as a signed integer."""
    codes = F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    two = F.lit(2**32)
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c + F.lit(2**31), two) - F.lit(2**31)))


def hash_embedding(words: Column) -> Column:
    """Unit vector of 100 dimensions: the mean over the words of sin((hash + d) * 0.1); zeros without words.

    The hashes are taken in the JVM, the vectors batch by batch in numpy: as nested higher-order functions every
    dimension would hash all words again.
    """

    @F.arrow_udf("array<double>")
    def vectors(hashes: pa.Array) -> pa.Array:
        rows = []
        for own in hashes.to_pylist():
            raw = np.sin((np.array(own or [], dtype=np.float64)[:, None] + np.arange(DIMENSIONS)) * 0.1).sum(0) / max(1, len(own or []))
            norm = np.linalg.norm(raw)
            rows.append((raw / norm if norm > 0 else raw).tolist())
        return pa.array(rows, pa.list_(pa.float64()))

    return vectors(F.transform(words, hash32))


def context_score(text: Column, terms: list[str], age_days: Column) -> Column:
    """Mean number of literal hits of the terms per word, times a decay over 30 days not below 0.1, at most 1."""
    words = F.greatest(F.size(F.split(text, r"\s+")), F.lit(1))
    low = F.lower(text)
    hits = reduce(lambda a, b: a + b, ((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t) for t in terms))
    return F.least(F.lit(1.0), hits / len(terms) / words * F.greatest(F.lit(0.1), 1 - age_days / 30))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Fixed-stride pieces of a text as array<struct<chunk_index, chunk>>; null and empty texts have none."""
    stride = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / stride).cast("int"))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), F.substring(text, i * stride + 1, F.lit(size)).alias("chunk")))
    return F.when(F.length(text) > 0, made)


def proximity(path: Column, folder: str) -> Column:
    """0.4 in the folder, 0.25 below it, by whole path segments; 0 elsewhere."""
    own = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(own == folder, 0.4).when(own.startswith(folder + "/"), 0.25).otherwise(0.0)
