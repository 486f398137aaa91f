"""Turtle documents: a tokenizing parser, a serializer and their DataFrame forms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, line_no int, subject string, predicate string, object string, object_type string, datatype string, lang string"
_TOKEN = re.compile(
    r"#[^\n]*|(?P<iri><[^<>\"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:\w+)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z][\w\-]*:(?:[\w\-]|[./%#+](?=[\w\-]))*|:(?:[\w\-]|\.(?=\w))+|[A-Za-z]\w*)|(?P<sign>[.;,()\[\]])",
    re.S,
)
_ESCAPE = re.compile(r"\\([tnrbf\"'\\]|u[0-9A-Fa-f]{4})")
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else _ESCAPES.get(m[1], m[1]), text)


def parse(text: str) -> Iterator[tuple[int, str, str, str, str, str | None, str | None]]:
    """(line, subject, predicate, object, type, datatype, language) of each statement.

    Prefixed names are expanded where their prefix is declared. A statement that cannot be read is left out up to
    its final dot, so that one bad line does not lose a document.
    """
    prefixes: dict[str, str] = {}
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup]
    breaks = [0, *(m.end() for m in re.finditer("\n", text))]

    def term(kind: str, word: str) -> tuple[str, str]:
        if kind == "iri":
            return word[1:-1], "uri"
        if kind == "blank":
            return word, "blank"
        if kind == "name":
            prefix, colon, rest = word.partition(":")
            return (prefixes[prefix + ":"] + rest if colon and prefix + ":" in prefixes else word), "uri"
        if kind == "number":
            return word, "literal"
        quotes = 3 if kind == "long" else 1
        return _plain(word[quotes:-quotes]), "literal"

    from bisect import bisect_right

    at, subject, predicate = 0, None, None
    while at < len(tokens):
        kind, word, place = tokens[at]
        if kind == "at" and word in ("@prefix", "@base") or kind == "name" and word.upper() in ("PREFIX", "BASE"):
            if at + 2 < len(tokens) and tokens[at + 2][0] == "iri":
                prefixes[tokens[at + 1][1]] = tokens[at + 2][1][1:-1]
            at += 3
            if at < len(tokens) and tokens[at][1] == ".":
                at += 1
            subject = predicate = None
        elif kind == "sign":
            if word in ".":
                subject = predicate = None
            elif word == ";":
                predicate = None
            at += 1
        elif subject is None:
            subject = term(kind, word)[0]
            at += 1
        elif predicate is None:
            predicate = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if word == "a" else term(kind, word)[0]
            at += 1
        else:
            value, what = term(kind, word)
            datatype = language = None
            if word in ("true", "false"):
                what, datatype = "literal", "xsd:boolean"
            elif kind == "number":
                datatype = "xsd:decimal" if "." in word else "xsd:integer"
            at += 1
            if at < len(tokens) and tokens[at][0] == "at" and what == "literal":
                language = tokens[at][1][1:]
                at += 1
            elif at + 1 < len(tokens) and tokens[at][0] == "type":
                datatype = term(*tokens[at + 1][:2])[0]
                at += 2
            yield bisect_right(breaks, place), subject, predicate, value, what, datatype, language


def read(files: DataFrame, path: str, text: str) -> DataFrame:
    """Statements of Turtle documents given as rows of a path and a text; null texts have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "line_no", "subject", "predicate", "object", "object_type", "datatype", "lang"]
        for batch in batches:
            found = [(p, *s) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in parse(t or "")]
            columns = list(zip(*found, strict=True)) if found else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "line_no" else pa.string()) for c, n in zip(columns, names, strict=True)], names)

    return files.select(F.col(path).cast("string"), text).mapInArrow(rows, SCHEMA)


def load(spark, glob: str) -> DataFrame:
    """Statements of all Turtle files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ttl").load(glob)
    return read(files.select("path", F.decode("content", "utf-8").alias("text")), "path", "text")


def _written(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(""))
    return F.when(kind == "literal", literal).when(kind == "blank", value).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def write(statements: DataFrame) -> DataFrame:
    """`path, text`: one Turtle document per path, a statement a line, sorted."""
    named = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    line = F.concat_ws(" ", named("subject"), named("predicate"), _written(F.col("object"), F.col("object_type"), F.col("datatype"), F.col("lang")), F.lit("."))
    return statements.select("path", line.alias("line")).groupBy("path").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("text"))
