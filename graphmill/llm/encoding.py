"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bpe import VOCABULARY, encoder


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of a string column as array<int>.

    Null gives null, an empty text the empty list; white space is text like any other and strings of special
    tokens are ordinary text. Repeated texts are encoded each for itself, whole texts whatever their length.
    """

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode_array
        rows = [None if x is None else encode(x) for x in texts.to_pylist()]
        ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
        offsets = pa.array(ends, mask=np.array([*(r is None for r in rows), False]))
        return pa.ListArray.from_arrays(offsets, pa.array(flat))

    return ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a string column; null for null."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        of = encoder(vocabulary).count
        return pa.array([None if x is None else of(x) for x in texts.to_pylist()], pa.int32())

    return count(text)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def text_of(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text that token ids stand for; null for null."""

    @F.arrow_udf("string")
    def join(rows: pa.Array) -> pa.Array:
        words = encoder(vocabulary).words
        return pa.array([None if r is None else "".join([words[i] for i in r]).encode("latin-1").decode("utf-8") for r in rows.to_pylist()], pa.string())

    return join(ids)


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text as its token ids spell it, and whether it has none."""
    ids = p8_ids(spark, d)
    return ids.select("doc_id", F.md5(text_of(F.col("ids"))).alias("digest"), (F.size("ids") == 0).alias("is_empty"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
SQL = {"p8_roundtrip": "SELECT doc_id, md5(text) AS digest, text = '' AS is_empty FROM documents"}
