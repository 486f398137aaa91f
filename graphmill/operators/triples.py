"""Triple store operators: identity, insertion, removal, patterns, distinct terms, keyword search, index statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("subject", "predicate", "object")


def triple_id() -> Column:
    """Identity of a triple: its three terms and the type of its object."""
    return F.md5(F.concat_ws("|", "subject", "predicate", "object", "object_type"))


def insert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` that are not in the store, each once."""
    fresh = new.withColumn("id", triple_id()).dropDuplicates(["id"])
    return fresh.join(store.select(triple_id().alias("id")), "id", "left_anti")


def bound(subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> Column:
    """Condition of a pattern; None matches anything, an empty string only itself."""
    given = {"subject": subject, "predicate": predicate, "object": obj}
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in given.items() if v is not None), F.lit(True))


def match(store: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, limit: int | None = None) -> DataFrame:
    """Triples that fit the pattern; with a limit the first by their terms."""
    found = store.where(bound(subject, predicate, obj))
    return found if limit is None else found.orderBy(*KEY).limit(limit)


def remove(store: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    return store.where(~bound(subject, predicate, obj))


def exists(store: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """One row with `found`."""
    return store.where(bound(subject, predicate, obj)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def terms(store: DataFrame, what: str, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Distinct subjects, predicates or objects of a pattern."""
    return store.where(bound(subject, predicate, obj)).select(what).distinct()


def keyword(store: DataFrame, words: list[str]) -> DataFrame:
    """Triples whose text holds any of the words, without regard to case."""
    text = F.lower(F.concat_ws(" ", *KEY))
    return store.where(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w.lower())) for w in words)))


def fulltext(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index of words with more than two characters: `token, n_docs, n_hits`."""
    words = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: F.length(w) > 2)
    hits = docs.select(F.col(key).alias("k"), F.explode(words).alias("token")).groupBy("token", "k").agg(F.count(F.lit(1)).alias("n"))
    return hits.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_hits"))


def index_sizes(store: DataFrame) -> DataFrame:
    """Distinct keys of the one- and two-part indexes, in one pass: each triple gives its six keys, made distinct before they are shuffled.

    Keys are told apart by two hashes of 64 bits.
    """
    shapes = {"s": ["subject"], "p": ["predicate"], "o": ["object"], "sp": ["subject", "predicate"], "po": ["predicate", "object"], "so": ["subject", "object"]}
    keys = F.array(*(F.struct(F.lit(name).alias("index_name"), F.xxhash64(*c).alias("a"), F.xxhash64(F.lit(name), *reversed(c)).alias("b")) for name, c in shapes.items()))
    return store.select(F.inline(keys)).distinct().groupBy("index_name").agg(F.count(F.lit(1)).alias("n_keys"))


def routed(store: DataFrame, edges: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A store as (edges `subject, edge_type, target`, properties `subject, properties`).

    A predicate that holds a key of `edges`, the first in order, leads to an edge of that type; all others become
    properties, of several values of one the greatest.
    """
    kind = F.coalesce(*(F.when(F.contains("predicate", F.lit(k)), F.lit(v)) for k, v in edges.items()), F.lit(None).cast("string"))
    told = store.withColumn("edge_type", kind)
    links = told.where("edge_type is not null").select("subject", "edge_type", F.col("object").alias("target")).distinct()
    values = told.where("edge_type is null").groupBy("subject", "predicate").agg(F.max("object").alias("object"))
    return links, values.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("predicate", "object"))).alias("properties"))
