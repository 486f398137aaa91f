"""Retrieval for an assistant: file relevance, context documents, recursive chunks, triple vectors and thresholds."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relevance import Question, _hash
from .search import DIMENSIONS

SEPARATORS = ("\n\n", "\n", " ", "")
#: Weights of the parts of a triple and of a tag in its vector.
PARTS = (0.4, 0.4, 0.2)
TAG = 0.1


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _given(condition: Column, weight: float) -> Column:
    return F.when(condition, weight).otherwise(0.0)


def _holds(text: Column, word: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word.lower()))


def _names_hold(names: Column, word: str) -> Column:
    return F.coalesce(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(word.lower()))), F.lit(False))


def file_relevance_full(place: str, language: str, words: tuple[str, ...], intent: str) -> Column:
    """Relevance of a file to a place, a language, words and an intent (its words in the path), at most 1.

    0.4 in the folder or 0.25 below it, 0.3 language, 0.2 for words in the text, 0.15 for remarks with one, 0.1 for the
    intent, 0.15 for an import, 0.15 for a class and 0.1 for a method whose name has one. Needs `file_path, language,
    source_code, imports, class_names, method_names`.
    """
    own = folder(F.col("file_path"))
    near = F.when(own == place, 0.4).when(own.startswith(place + "/"), 0.25).otherwise(0.0)
    any_of = lambda f: reduce(lambda a, b: a | b, (f(w) for w in words))
    remark = any_of(lambda w: F.coalesce(F.col("source_code"), F.lit("")).rlike(rf"(?im)^\s*(?:#|//|\*|/\*).*{w}"))
    parts = (
        near, _given(F.col("language") == language, 0.3), _given(any_of(lambda w: _holds(F.col("source_code"), w)), 0.2), _given(remark, 0.15), _given(_holds(F.col("file_path"), intent), 0.1),
        _given(any_of(lambda w: _names_hold(F.col("imports"), w)), 0.15), _given(any_of(lambda w: _names_hold(F.col("class_names"), w)), 0.15), _given(any_of(lambda w: _names_hold(F.col("method_names"), w)), 0.1),
    )
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def file_relevance_b(request: str, query: str) -> Column:
    """0.5 in the folder of the request or 0.3 above or below it, 0.3 language in its path, 0.4 query in the text, 0.2 an import in its path."""
    place, own = request.rpartition("/")[0], folder(F.col("file_path"))
    near = F.when(own == place, 0.5).when(own.startswith(place + "/") | F.startswith(F.lit(place), F.concat(own, F.lit("/"))), 0.3).otherwise(0.0)
    imported = F.coalesce(F.exists("imports", lambda m: (m != "") & F.contains(F.lit(request), m)), F.lit(False))
    return near + _given(F.contains(F.lit(request), F.col("language")), 0.3) + _given(_holds(F.col("source_code"), query), 0.4) + _given(imported, 0.2)


def file_relevance_c(request: str, query: str, enhanced: Column) -> Column:
    """10 in the same folder, 5 less the steps to a folder at most two away, 15 for the query in the text, 5 if enhanced."""
    here = request.rpartition("/")[0].split("/")
    there = F.split(folder(F.col("file_path")), "/")
    same = reduce(lambda n, k: F.when(n == k, F.when(F.get(there, F.lit(k)) == here[k], k + 1).otherwise(n)).otherwise(n), range(len(here)), F.lit(0))
    steps = F.lit(len(here)) + F.size(there) - same * 2
    close = F.when(steps == 0, 10 + 4).when(steps <= 2, 5 - steps).otherwise(0)
    return close + F.when(_holds(F.col("source_code"), query), 15).otherwise(0) + F.when(enhanced, 5).otherwise(0)


def file_relevance_d(request: str, language: str, query: str) -> Column:
    """0.5, and 0.4 for the file itself or 0.2 in its folder, 0.3 text, 0.2 class, 0.1 method, 0.2 language; at most 1."""
    path = F.col("file_path")
    near = F.when(path == request, 0.4).when(F.contains(path, F.lit(request.rpartition("/")[0])), 0.2).otherwise(0.0)
    hits = _given(_holds(F.col("source_code"), query), 0.3) + _given(_names_hold(F.col("class_names"), query), 0.2) + _given(_names_hold(F.col("method_names"), query), 0.1)
    return F.least(F.lit(1.0), F.lit(0.5) + near + hits + _given(F.col("language") == language, 0.2))


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most `size`: cut at the coarsest separator that keeps them small enough.

    A chunk begins with up to `overlap` characters of the one before it, from a word on.
    """
    pieces: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= size - overlap:
            pieces.append((lo, hi))
            continue
        sign = SEPARATORS[level]
        if not sign:
            step = size - overlap
            pieces += [(a, min(hi, a + step)) for a in range(lo, hi, step)]
            continue
        parts, at = [], lo
        while (found := text.find(sign, at, hi)) >= 0:
            parts.append((at, found + len(sign)))
            at = found + len(sign)
        parts.append((at, hi))
        todo += [(a, b, level + 1) for a, b in reversed(parts) if b > a]
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and b - out[-1][0] <= size - overlap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    chunks = []
    for n, (a, b) in enumerate(out):
        begin = a
        if n and overlap:
            low = max(out[n - 1][0], a - overlap)
            blank = text.find(" ", low, a)
            begin = blank + 1 if 0 <= blank < a - 1 else low
        chunks.append((begin, b))
    return chunks


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """`key, chunk_index, n_chunks, start_pos, new_pos, chunk, chunk_hash`; null and empty texts have none.

    `new_pos` is where a chunk goes on after what it repeats of the one before it.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    schema = pa.list_(pa.struct([("chunk_index", pa.int32()), ("n_chunks", pa.int32()), ("start_pos", pa.int32()), ("new_pos", pa.int32()), ("chunk", pa.string()), ("chunk_hash", pa.string())]))

    @F.arrow_udf("array<struct<chunk_index:int,n_chunks:int,start_pos:int,new_pos:int,chunk:string,chunk_hash:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            found, before, own = split_text(t, size, overlap), 0, []
            for n, (a, b) in enumerate(found):
                own.append({"chunk_index": n, "n_chunks": len(found), "start_pos": a, "new_pos": before, "chunk": t[a:b], "chunk_hash": hashlib.md5(t[a:b].encode()).hexdigest()})
                before = b
            rows.append(own)
        return pa.array(rows, schema)

    return docs.where(F.length(text) > 0).select(key, F.inline(cut(text)))


def context_documents(contexts: DataFrame) -> DataFrame:
    """Documents for retrieval from the context of a file: one per function, per class, and one of its imports.

    `file_id, version, doc_type, name, content`; a file without any gives no row.
    """
    c = contexts.select("file_id", "version", "functions", "classes", "imports")
    base = ["file_id", "version"]
    functions = c.select(*base, F.explode("functions").alias("f")).select(
        *base, F.lit("function").alias("doc_type"), F.col("f.name").alias("name"), F.concat_ws("\n", F.coalesce("f.signature", "f.name"), "f.docstring").alias("content")
    )
    classes = c.select(*base, F.explode("classes").alias("k")).select(
        *base, F.lit("class").alias("doc_type"), F.col("k.name").alias("name"), F.concat(F.lit("class "), F.coalesce("k.name", F.lit("")), F.lit(": "), F.array_join("k.methods", ", ")).alias("content")
    )
    imports = c.where(F.size("imports") > 0).select(*base, F.lit("imports").alias("doc_type"), F.lit(None).cast("string").alias("name"), F.array_join("imports.module", "\n").alias("content"))
    return functions.unionByName(classes).unionByName(imports)


def relevant_documents(docs: DataFrame, place: str | None, language: str | None, query: str) -> DataFrame:
    """Documents of a place or a language, or with any word of the query that has more than two characters."""
    terms = [w.lower() for w in query.split() if len(w) > 2]
    wanted = [F.col("source") == place] if place else []
    wanted += [F.lower("lang") == language.lower()] if language else []
    wanted += [F.contains(F.lower("text"), F.lit(t)) for t in terms]
    return docs.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def triple_vector(tags: str | None = None) -> Column:
    """Unit vector of a triple: 0.4 subject, 0.4 predicate, 0.2 object of cos((hash + d) * 0.1), and its tags."""

    @F.arrow_udf("array<double>")
    def vectors(s: pa.Array, p: pa.Array, o: pa.Array, tagged: pa.Array) -> pa.Array:
        dims, out = np.arange(DIMENSIONS), []
        for *terms, own in zip(s.to_pylist(), p.to_pylist(), o.to_pylist(), tagged.to_pylist(), strict=True):
            raw = sum(np.cos((_hash(t or "") + dims) * 0.1) * w for t, w in zip(terms, PARTS, strict=True))
            raw = raw + sum((np.sin((_hash(t) + dims) * 0.05) * TAG for t in own or ()), np.zeros(DIMENSIONS))
            norm = np.linalg.norm(raw)
            out.append((raw / norm if norm > 0 else raw).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return vectors("subject", "predicate", "object", F.col(tags) if tags else F.array().cast("array<string>"))


def threshold(question: Question, n_triples: int, base: float = 0.1) -> float:
    """The least score of a hit: lower for long questions and small stores, higher for short ones and large stores, at most 0.1."""
    weight = len(question.terms) + sum(w for _, w in question.terms)
    level = base * (0.9 if weight > 5 else 1.1 if weight < 2 else 1.0)
    return min(level * (1.1 if n_triples > 1000 else 0.8 if n_triples < 100 else 1.0), 0.1)


def at_least(scored: DataFrame, score: str, least: float, fallback: int, *order: Column) -> DataFrame:
    """Rows with the least score; if there are none, the first `fallback` rows in order, with a score of 0.1."""
    first = scored.orderBy(*order).limit(fallback).withColumn(score, F.lit(0.1))
    good = scored.where(F.col(score) >= least)
    best = scored.agg(F.max(score)).scalar()
    return good.unionByName(first.where(F.coalesce(best, F.lit(0.0)) < least))


def snippet(text: Column, word: str) -> Column:
    """The word with the one before and after it, at its first place without regard to case; null where it does not stand."""
    words = F.split(F.trim(text), r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w)), word.lower()).cast("int")
    return F.when(at > 0, F.array_join(F.slice(words, F.greatest(F.lit(1), at - 1), F.when(at > 1, 3).otherwise(2)), " "))
