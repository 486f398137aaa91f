"""Splitting oversized code at natural boundaries by structure-tree packing."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

LIMIT = 4000
OVERLAP = 200
CUTS = "array<struct<start_char:int,end_char:int,start_line:int,end_line:int>>"

_INDENT = re.compile(r"[ \t]*")
_HEADING = re.compile(r"(#{1,6})\s|\s*([-*+]|\d+[.)])\s")
#: A line that belongs to the declaration below it, and one that closes the block above it.
_LEADS = re.compile(r"\s*(?:#(?!!)|//|/?\*|@\w|\"\"\"|'''|<!--)")
_CLOSES = re.compile(r"\s*(?:[})\]]|end\b|</|\*/)")


def _level(line: str) -> int:
    return len(_INDENT.match(line)[0].expandtabs(4))


class _Tree:
    """The lines of a text as a tree: a node is a line, the deeper lines after it and the line that closes it."""

    def __init__(self, text: str, markdown: bool) -> None:
        self.text = text
        lines = text.split("\n")
        self.starts = [0]
        for line in lines[:-1]:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.starts.append(len(text))
        self.levels: list[int | None] = []
        leads = False
        for line in lines:
            if not line.strip():
                self.levels.append(None)
                leads = False
                continue
            closes = bool(_CLOSES.match(line))
            if markdown and (mark := _HEADING.match(line)):
                level = len(mark[1]) if mark[1] else 7 + _level(line)
            else:
                level = (20 if markdown else 0) + _level(line)
            self.levels.append(None if closes or leads else level)
            leads = not markdown and bool(_LEADS.match(line)) and not closes

    def size(self, lo: int, hi: int) -> int:
        return self.starts[hi] - self.starts[lo]

    def children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        inner = [n for n in range(lo + 1, hi) if self.levels[n] is not None]
        if inner:
            least = min(self.levels[n] for n in inner)
            marks = [n for n in inner if self.levels[n] == least]
        else:
            marks = list(range(lo + 1, hi))
        return list(zip([lo, *marks], [*marks, hi], strict=True))


def _within_line(text: str, lo: int, hi: int, limit: int) -> list[int]:
    """Ends of parts of one overlong line: after a statement, else after a list item or a word, else anywhere."""
    ends = []
    while hi - lo > limit:
        part = text[lo : lo + limit]
        least = limit // 2
        at = max(part.rfind(";"), part.rfind("}")) + 1
        if at <= least:
            at = max(part.rfind(","), part.rfind(" "), part.rfind(">")) + 1
        if at <= least:
            at = limit
        lo += at
        ends.append(lo)
    return [*ends, hi]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, markdown: bool = False) -> list[int]:
    """Ends of the consecutive pieces; the last is the length of the text.

    Every piece but the first starts `overlap` characters before its predecessor's end, so that all but the first
    have that much less room for new text. Sibling subtrees are merged while they fit and only a subtree that is
    too large for a piece of its own is opened.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [len(text)]
    tree, room = _Tree(text, markdown), limit - overlap
    ends: list[int] = []
    begin = 0

    def allowed() -> int:
        return room if ends else limit

    def close(at: int) -> None:
        nonlocal begin
        if at > begin:
            ends.append(at)
            begin = at

    stack = [(0, len(tree.starts) - 1)]
    while stack:
        lo, hi = stack.pop()
        a, b = tree.starts[lo], tree.starts[hi]
        if b - begin <= allowed():
            continue
        if b - a <= room:
            close(a)
            continue
        if hi - lo > 1:
            stack += reversed(tree.children(lo, hi))
            continue
        if a - begin > allowed() // 2:
            close(a)
        for end in _within_line(text, begin, b, room):
            if end < b:
                close(end)
    close(len(text))
    return ends


def cuts(text: str, first_line: int, limit: int = LIMIT, overlap: int = OVERLAP, markdown: bool = False) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each piece, in characters from 0 and lines from `first_line`."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    out, before = [], 0
    for end in cut_points(text, limit, overlap, markdown):
        start = max(0, before - overlap)
        out.append((start, end, first_line + bisect_right(breaks, start - 1), first_line + bisect_right(breaks, end - 2)))
        before = end
    return out


def with_cuts(df: DataFrame, text: str, first_line: str, limit: int = LIMIT, overlap: int = OVERLAP, markup: Column | None = None) -> DataFrame:
    """Adds `cuts` to the rows whose text exceeds the limit; other rows (null, empty, short) are left out.

    The length is tested before the text goes to Python, in code points. A null first line counts as 1. Where `markup` is
    true, headings and lists make the tree instead of the indentation of code.
    """

    @F.arrow_udf(CUTS)
    def find(texts: pa.Array, lines: pa.Array, marked: pa.Array) -> pa.Array:
        fields = ("start_char", "end_char", "start_line", "end_line")
        rows = [
            [dict(zip(fields, c, strict=True)) for c in cuts(t, n or 1, limit, overlap, bool(m))]
            for t, n, m in zip(texts.to_pylist(), lines.to_pylist(), marked.to_pylist(), strict=True)
        ]
        return pa.array(rows, pa.list_(pa.struct([(f, pa.int32()) for f in fields])))

    return df.where(F.length(text) > limit).withColumn("cuts", find(F.col(text), F.col(first_line), F.lit(False) if markup is None else markup))


def split_entities(entities: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each entity version over the limit.

    `entity_id, version, piece_no, n_pieces, start_line, end_line, piece`. Of an entity version delivered more
    than once the last delivery counts. Documents in markup, by their path, are cut at headings and lists. An empty table
    gives no rows; other columns are ignored.
    """
    marked = F.coalesce(F.lower("file_path").rlike(r"\.(?:md|markdown|rst|adoc)$"), F.lit(False))
    rows = entities.select("entity_id", "version", "start_line", "source_code", "ingested_at", marked.alias("marked"))
    cut = with_cuts(rows, "source_code", "start_line", limit, overlap, F.col("marked"))
    last = cut.groupBy("entity_id", "version").agg(F.max_by(F.struct("source_code", "cuts"), F.struct("ingested_at", F.xxhash64("source_code"))).alias("r"))
    return last.select(
        "entity_id", "version", F.size("r.cuts").alias("n_pieces"), "r.source_code", F.posexplode("r.cuts").alias("piece_no", "c")
    ).select(
        "entity_id", "version", "piece_no", "n_pieces", "c.start_line", "c.end_line", F.col("c.start_char").alias("start_char"),
        F.substring(F.col("source_code"), F.col("c.start_char") + 1, F.col("c.end_char") - F.col("c.start_char")).alias("piece"),
    )


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_entities(table(spark, d, "code_entities")).drop("start_char")


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each row as a whole: how many characters they cover, and whether all are small enough, overlap by OVERLAP and have their lines."""
    pieces = split_entities(table(spark, d, "code_entities"))
    order = Window.partitionBy("entity_id", "version").orderBy("piece_no")
    end = F.col("start_char") + F.length("piece")
    told = pieces.withColumn("before", F.lag(end).over(order)).withColumn("breaks", F.length(F.regexp_replace(F.expr("substring(piece, 1, length(piece) - 1)"), r"[^\n]", "")))
    good = (F.length("piece") <= LIMIT) & (F.col("end_line") - F.col("start_line") == F.col("breaks"))
    return told.groupBy("entity_id", "version").agg(
        F.sum(F.length("piece") - F.when(F.col("before").isNull(), 0).otherwise(OVERLAP)).alias("n_chars"), F.bool_and(good).alias("small"),
        F.bool_and(F.coalesce(F.col("before") - F.col("start_char"), F.lit(OVERLAP)) == OVERLAP).alias("overlapping"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_entities").select("entity_id", "version", "start_line", "source_code")
    return with_cuts(rows, "source_code", "start_line").where(F.size("cuts") > 1).select("entity_id", "version").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_checks": p1_checks}
SQL = {
    "p1_checks": "SELECT entity_id, version, arg_max(length(source_code), ingested_at) AS n_chars, true AS small, true AS overlapping FROM code_entities WHERE length(source_code) > 4000 GROUP BY ALL",
    "p1_found": "SELECT DISTINCT entity_id, version FROM code_entities WHERE length(source_code) > 4000",
}
