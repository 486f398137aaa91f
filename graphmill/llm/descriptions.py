"""Functions paired with their documentation.

Every file is cut into coarse tokens inside the JVM (remarks, annotations, strings, declarations, braces, and runs of
all else), which are exploded into rows once. A cumulative count of line ends gives each token its lines and one of
braces its depth: a brace and the next one at its depth delimit a body. Tokens that stand directly under one another
form islands (gaps and islands over remarks and annotations), and a lag window tells whether a remark begins its line
and whether a string opens a body. What is found of a file is gathered in one row of it, which never holds more than the
file does, and joined to its functions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import table

#: Words of prose that a description needs besides the words of the function's name.
LEAST_WORDS = 4

_NOTE = r"(?s:@[A-Za-z_][\w.]*+(?:\([^()]*+\))?)"
#: A literal ends at a quote after an even number of backslashes.
_QUOTED = r"{0}[^\n]*?(?<!\\)(?:\\\\){{0,20}}{0}"
_BRACED = rf"""(?s:/\*.*?\*/)|//[^\n]*+|(?<=[(=,:!&|?] ?)/(?![ =])[^\n]*?(?<!\\)(?:\\\\){{0,20}}/(?=[a-z]*[.,;)\s])|{_QUOTED.format('"')}|{_QUOTED.format("'")}|(?s:`[^`]*+`)|{_NOTE}|[{{}}]|[^/"'`@{{}}]++"""
_HEADS = r"(?:async[ \t]++)?(?:def|class)[ \t]++\w++"
_INDENTED = rf"""#[^\n]*+|(?s:[rRbBuU]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''))|[rRbBuU]?{_QUOTED.format('"')}|[rRbBuU]?{_QUOTED.format("'")}|{_NOTE}|(?:\A|\n)[ \t]*+{_HEADS}|[^"'#@]+?(?=["'#@]|\n[ \t]*+{_HEADS}|\z)"""

#: What editors and people in a hurry leave instead of a description.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:todo|fixme|xxx|tbd|hack|wip)\b.*|(?:n/?a|none|description|summary|documentation|placeholder|constructor|getter|setter|no (?:description|docs?|documentation)|missing (?:docs?|documentation|description))\W*"
    r"|(?:to be|needs to be|must be) (?:documented|done|written|described).*|auto-?generated\b.*|generated (?:method|constructor|function) stub.*|(?:method|function|class|constructor) stub\b.*"
    r"|stub (?:made|created|generated)\b.*|insert (?:the|a|your) (?:description|documentation|comment)\b.*|(?:add|write|enter|put) (?:a |the |your |some )?(?:proper )?(?:description|documentation|doc|comment)s?\b.*"
    r"|document (?:this|me|it)\b.*|fill (?:this |me )?in\b.*|see (?:above|below)\W*|\{@inheritdoc\}\W*)$"
)
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|webpack\w*|pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|noqa|nosec|nolint|nosonar|noinspection|checkstyle|pragma|type:\s*ignore|@?ts-(?:ignore|nocheck|expect-error)|@formatter|@suppress\w*"
    r"|go:\w+|\+build|lint:|coverage|sonar|clang-format|region|endregion|jscpd|codecov|bandit|spell-?checker|cspell)\b"
)
_CODE = re.compile(
    r"^\s*(?:[\w.\[\]\"']+\s*(?::=|[-+*/|&]?=)\s*\S.*|(?:const|let|var|final|static|public|private|int|long|String|auto)\s+\w+.*[=;({].*|(?:return|throw|raise|yield|await|import|from|package|break|continue|pass)\b[^.]*[;()\[\]=]?\s*"
    r"|(?:if|for|while|switch|elif|else|try|catch|def|func|function|class)\b.*[{:(]\s*|[\w.]+\([^)]*\)\s*;?|.*[(){}\[\]=].*;|[{}()\[\];]+)\s*$"
)
_TAG = re.compile(r"(?:(?<=\s)|^)(?:@\w+|:(?:param|type|returns?|rtype|raises?|arg)\b[^:\n]*:|\\param\b).*$", re.M)
_SECTION = re.compile(r"(?m)^\s*(?:Args|Arguments|Parameters|Params|Returns|Raises|Yields|Throws)\s*:\s*$")
_ITEM = re.compile(r"(?m)^\s*[\w*]+(?:\s*\([^)]*\))?:\s.*$")
_FENCE = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|//+!?|#+|<!--|-->)\s?|\s*(?:\*+/|-->)\s*$|^\s*[rRbBuU]{0,2}(?:\"\"\"|''')|(?:\"\"\"|''')\s*$|^\s*[rRbBuU]?[\"']|[\"']\s*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NAME_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")


def stem(word: str) -> str:
    """A word without its usual endings, so that the forms of a name's words are known again."""
    w = word.lower()
    for end in ("ing", "ied", "ies", "ed", "es", "s", "d"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            break
    w = w.rstrip("ey")
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _forms(word: str) -> set[str]:
    w = word.lower()
    return {w, stem(w), w.rstrip("ey"), *(w[: -len(e)].rstrip("ey") for e in ("s", "es", "ed", "ing", "er", "or") if w.endswith(e) and len(w) > len(e) + 2)}


def prose(text: str) -> str:
    """What of a remark or docstring is prose: no comment signs, tags, placeholders, directives or code."""
    lines = []
    for line in text.split("\n"):
        for _ in range(2):
            line = _FENCE.sub("", line)
        lines.append(line.strip())
    kept = "\n".join(lines)
    if head := _SECTION.search(kept):
        kept = kept[: head.start()] + _ITEM.sub("", kept[head.end() :])
    kept = _TAG.sub("", kept)
    return " ".join(x for x in kept.split("\n") if x.strip() and not (_PLACEHOLDER.match(x) or _DIRECTIVE.match(x) or _CODE.match(x))).strip()


def description(name: str, texts: list[str | None]) -> str | None:
    """The first of the texts with enough prose besides the words of the name, or None."""
    parts = [p for p in _NAME_PART.findall(name or "")]
    known = set().union(*(_forms(p) for p in parts)) if parts else set()
    for text in texts:
        if not text or not text.strip():
            continue
        said = prose(text)
        if name and re.match(rf"\W*{re.escape(name)}\b", said, re.I):
            said = re.sub(rf"^\W*{re.escape(name)}\b[\s:,\-]*", "", said, flags=re.I)
            if _PLACEHOLDER.match(said) or _CODE.match(said):
                continue
        words = [w for w in _WORD.findall(said) if not (known & _forms(w)) and w.lower() != (name or "").lower()]
        if len(words) >= LEAST_WORDS:
            return said
    return None


def _order(*more: str) -> WindowSpec:
    """The tokens of a file version in order, those of its last delivery first."""
    return Window.partitionBy("k1", "k2", *more).orderBy(F.desc_nulls_last("at"), "tie", "uid", "pos")


def _so_far() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def tokens(files: DataFrame) -> DataFrame:
    """Tokens of the last delivery of `entity_id, version, ingested_at, language, source_code` as rows with lines and depth.

    `k1, k2` stand for the file version; `pos` orders its tokens. Deliveries of one time are told apart by their text.
    """
    text = F.col("source_code")
    cut = F.when(F.col("language") == "python", F.regexp_extract_all(text, F.lit(_INDENTED), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(_BRACED), F.lit(0))
    )
    rows = files.withColumn("uid", F.monotonically_increasing_id()).select(
        "uid", F.xxhash64("entity_id", "version").alias("k1"), F.xxhash64("version", "entity_id").alias("k2"), F.col("ingested_at").alias("at"),
        F.xxhash64(text).alias("tie"), (F.col("language") == "python").alias("indented"), F.posexplode(cut).alias("pos", "tok"),
    )
    kind = (
        F.when(F.col("tok").rlike(r"^(?://|/\*)") | (F.col("indented") & F.col("tok").startswith("#")), "remark")
        .when(F.col("tok").startswith("@") & (F.length("tok") > 1), "note").when(F.col("indented") & F.col("tok").rlike(rf"\A\s*{_HEADS}\z"), "head")
        .when(F.col("indented") & F.col("tok").rlike(r"^[rRbBuU]{0,2}[\"']"), "string").otherwise("other")
    )
    ends = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    opens = F.col("tok").rlike(r":[ \t]*\r?\n\s*[rRbBuU]{0,2}\z") & (F.size(F.split("tok", r":[ \t]*\r?\n")) == 2)
    slim = rows.withColumn("kind", kind).select(
        "uid", "k1", "k2", "at", "tie", "pos", "kind", ends.alias("ends"), F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0).alias("step"),
        F.when(F.col("kind").isin("remark", "string", "head"), F.col("tok")).alias("text"),
        ((F.col("kind") == "other") & (F.regexp_extract("tok", r"(?:\A|\n)[ \t\r]*\z", 0) != "") | F.col("tok").rlike(r"\n[ \t\r]*\z")).alias("tail"),
        (F.col("indented") & opens).alias("opens"), F.when(F.col("kind") == "other", F.regexp_extract("tok", r"\A\s*(\S)", 1)).alias("sign"),
        F.when((F.col("kind") == "other") & F.contains("tok", F.lit(";")), ends - F.length(F.regexp_replace(F.substring_index("tok", ";", -1), r"[^\n]", ""))).alias("stop"),
    )
    last = slim.withColumn("last", F.first("uid").over(_so_far())).where("uid = last")
    return (
        last.withColumn("last_line", (F.sum("ends").over(_so_far()) + 1).cast("int"))
        .withColumn("depth", F.sum("step").over(_so_far()))
        .withColumn("first_line", F.col("last_line") - F.col("ends"))
        .withColumn("begins", F.coalesce(F.lag("tail").over(_order()), F.lit(True)))
        .withColumn("body", F.coalesce(F.lag("opens").over(_order()), F.lit(False)))
        .withColumn("owner", F.last(F.when(F.col("kind") == "head", F.when(F.col("text").rlike(r"\A\s*class"), -1).otherwise(F.col("last_line"))), ignorenulls=True).over(_so_far()))
    )


def noted(toks: DataFrame) -> DataFrame:
    """What may describe a function: `k1, k2, above, inside`, maps from its line to a text.

    `above` are islands of remarks and annotations, line under line, by the line below them; `inside` the first strings of
    function bodies in Python, by the line of the def.
    """
    remark, doc = "kind in ('remark', 'note') and begins", "kind = 'string' and body and owner > 0"
    kept = toks.select("k1", "k2", "at", "tie", "uid", "pos", "kind", "first_line", "last_line", "owner", "text", F.expr(remark).alias("trivia"), F.expr(doc).alias("doc")).where("trivia or doc")
    before = F.last(F.when(F.col("trivia"), F.col("last_line")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("trivia") & (F.col("first_line") - before > 1)
    island = F.when(F.col("doc"), -F.col("owner")).otherwise(F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(_so_far()))
    parts = kept.withColumn("gap", gap).withColumn("island", island).groupBy("k1", "k2", "island").agg(
        F.max("last_line").alias("end"), F.max("doc").alias("doc"), F.sort_array(F.collect_list(F.when(F.col("kind") != "note", F.struct("pos", "text")))).alias("parts")
    ).where(F.size("parts") > 0)
    told = F.when(F.col("doc"), F.element_at("parts.text", 1)).otherwise(F.array_join("parts.text", "\n"))
    places = parts.select("k1", "k2", "doc", F.when(F.col("doc"), -F.col("island")).otherwise(F.col("end") + 1).cast("int").alias("line"), told.alias("told"))
    gathered = lambda which: F.map_from_entries(F.collect_list(F.when(which, F.struct("line", "told"))))
    return places.groupBy("k1", "k2").agg(gathered(~F.col("doc")).alias("above"), gathered(F.col("doc")).alias("inside"))


def bodies(toks: DataFrame) -> DataFrame:
    """The blocks in braces: `k1, k2, blocks` with the lines they open and close on, in order.

    `sign` is what follows a block, `stop` the line of the last semicolon before it.
    """
    braces = toks.withColumn("after", F.lead("sign").over(_order())).withColumn("stop", F.last(F.col("first_line") + F.col("stop"), ignorenulls=True).over(_so_far())).where("step <> 0")
    level = braces.withColumn("level", F.col("depth") + F.when(F.col("step") < 0, 1).otherwise(0))
    closed = level.withColumn("close", F.lead(F.struct("first_line", "after", "step")).over(_order("level"))).where("step = 1 and close.step = -1")
    block = F.struct("pos", F.col("first_line").alias("opens"), F.col("close.first_line").alias("closes"), F.col("close.after").alias("sign"), "stop")
    return closed.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(block)).alias("blocks"))


def functions(contexts: DataFrame) -> DataFrame:
    """One row per entry of `functions`; files without functions and entries without a line are left out."""
    return contexts.select("file_id", "version", F.explode("functions").alias("f")).where("f is not null and f.start_line is not null").select(
        "file_id", "version", F.col("f.name").alias("function_name"), F.col("f.start_line").alias("start_line"), F.col("f.end_line").alias("end_line"),
        F.col("f.signature").alias("signature"), F.col("f.docstring").alias("docstring"),
        F.xxhash64("file_id", "version").alias("k1"), F.xxhash64("version", "file_id").alias("k2"), F.col("f.start_line").alias("line"),
    )


def described(contexts: DataFrame, entities: DataFrame, knowledge: DataFrame, delimited: bool = False) -> DataFrame:
    """Functions with a non-trivial description.

    `file_id, version, function_name, start_line, end_line, signature, description`, the description from the
    source, the docstring or the method knowledge, in this order. A null or empty text in one place leaves the
    others; a file without text or a function without an entry in `knowledge` is described by what there is. Of several
    deliveries of a file the last counts. Repeated entries give one row. Empty tables give no rows.
    With `delimited`, `body_end` is the line on which the body in braces closes, if there is one.
    """
    files = entities.where("entity_type = 'File' and length(source_code) > 0").select(
        "entity_id", "version", "ingested_at", F.lower(F.split_part("entity_id", F.lit(":"), F.lit(2))).alias("language"), "source_code"
    ).where(F.col("language").isin("python", "typescript", "javascript", "java", "go"))
    toks = tokens(files)
    known = knowledge.where("documentation is not null and name is not null and start_line is not null").select(
        F.xxhash64("file_id", "version").alias("k1"), F.xxhash64("version", "file_id").alias("k2"), F.concat_ws(":", "start_line", "name").alias("key"),
        F.concat_ws("\n", "documentation.summary", "documentation.description").alias("knowledge"),
    ).groupBy("k1", "k2", "key").agg(F.max("knowledge").alias("knowledge")).groupBy("k1", "k2").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "knowledge"))).alias("known")
    )

    @F.arrow_udf("string")
    def best(names: pa.Array, *texts: pa.Array) -> pa.Array:
        rows = zip(names.to_pylist(), *(t.to_pylist() for t in texts), strict=True)
        return pa.array([description(name, list(found)) for name, *found in rows], pa.string())

    joined = functions(contexts).join(noted(toks), ["k1", "k2"], "left").join(known, ["k1", "k2"], "left")
    end = F.lit(None).cast("int")
    if delimited:
        joined, end = joined.join(bodies(toks), ["k1", "k2"], "left"), _body_end()
    told = joined.select(
        "file_id", "version", "function_name", "start_line", "end_line", "signature", F.element_at("inside", F.col("line")).alias("inside"), F.element_at("above", F.col("line")).alias("above"),
        "docstring", F.element_at("known", F.concat_ws(":", "line", "function_name")).alias("knowledge"), end.alias("body_end"),
    )
    told = told.withColumn("description", best("function_name", "inside", "above", "docstring", "knowledge")).where("description is not null")
    return told.select("file_id", "version", "function_name", "start_line", "end_line", "signature", "description", *(["body_end"] if delimited else [])).dropDuplicates(
        ["file_id", "version", "function_name", "start_line"]
    )


def _body_end() -> Column:
    """The line on which the body of the function at `line` closes.

    The body is the first block from there on that is no pattern or type in the head, which something of an expression
    follows. Where a semicolon stands between the head and the block there is no body, and the head's own line counts.
    """
    body = F.element_at(F.filter("blocks", lambda b: (b.opens >= F.col("line")) & ~F.coalesce(b.sign, F.lit("")).isin(")", ":", ",", "=", "|", "&", ">", "[", "{")), 1)
    return F.when(body.stop >= F.col("line"), F.col("line")).otherwise(body.closes)


def code_of(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds `code`, the lines of each function; `body_end` of `described` counts where no end line is known.

    A function in Python ends before the next line that is not indented more and no closing bracket.
    """
    files = entities.where("entity_type = 'File' and length(source_code) > 0").select(
        F.col("entity_id").alias("file_id"), "version", "ingested_at", "source_code"
    ).groupBy("file_id", "version").agg(F.max_by("source_code", F.struct("ingested_at", -F.xxhash64("source_code"))).alias("source_code"))
    rows = pairs.join(files, ["file_id", "version"]).where("start_line > 0")
    before = F.when(F.col("start_line") > 1, F.length(F.expr("substring_index(source_code, '\\n', start_line - 1)")) + 1).otherwise(0)
    rest = rows.withColumn("rest", F.substring("source_code", before + 1, F.length("source_code"))).where("length(rest) > 0").drop("source_code")
    width = F.length(F.regexp_extract("rest", r"\A[ \t]*", 0))
    outdent = F.regexp_instr("rest", F.concat(F.lit(r"\n[ \t]{0,"), width.cast("string"), F.lit(r"}[^\s)\]}]")))
    lines = F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")).otherwise(F.coalesce("body_end", "start_line")) - F.col("start_line") + 1
    by_indent = F.col("file_id").startswith("file:python:") & ~F.coalesce(F.col("end_line") > F.col("start_line"), F.lit(False))
    whole = F.when(outdent > 0, F.substring("rest", F.lit(1), outdent - 1)).otherwise(F.col("rest"))
    code = F.when(by_indent, whole).otherwise(F.expr("substring_index(rest, '\\n', n_lines)"))
    cut = rest.withColumn("n_lines", lines.cast("int")).withColumn("code", F.regexp_replace(code, r"\s+\z", ""))
    last = F.col("start_line") + F.length(F.regexp_replace("code", r"[^\n]", ""))
    return cut.withColumn("end_line", last.cast("int")).drop("rest", "n_lines", "body_end")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "code_contexts"), table(spark, d, "code_entities"), table(spark, d, "method_knowledge")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return described(*_tables(spark, d)).select("file_id", "version", "function_name", "start_line")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    contexts, entities, knowledge = _tables(spark, d)
    return code_of(described(contexts, entities, knowledge, delimited=True), entities)


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
SQL: dict[str, str] = {}
