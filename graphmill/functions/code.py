"""Measures and extractions over source text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of declarations by language and kind; the first group is the name.
DECLARATIONS = {
    "python": {"class": r"^\s*class\s+(\w+)", "function": r"^(?:async\s+)?def\s+(\w+)", "method": r"^\s+(?:async\s+)?def\s+(\w+)"},
    "typescript": {"class": r"^\s*(?:export\s+)?class\s+(\w+)", "interface": r"^\s*(?:export\s+)?interface\s+(\w+)", "function": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"},
    "javascript": {"class": r"^\s*(?:export\s+)?class\s+(\w+)", "function": r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"},
    "java": {"class": r"^\s*(?:public\s+)?class\s+(\w+)", "method": r"^\s+(?:public|private|protected)\s+(?:static\s+)?[\w<>, \[\]]+\s(\w+)\("},
    "go": {"struct": r"^type\s+(\w+)\s+struct", "function": r"^func\s+(\w+)\(", "method": r"^func\s+\([^)]*\)\s*(\w+)\("},
}

#: Keywords of design patterns with the weight of one hit.
PATTERNS = {
    "factory": (("factory", "create"), 0.3),
    "observer": (("observer", "listener", "subscribe", "notify"), 0.25),
    "repository": (("repository", "dao", "store"), 0.4),
    "service": (("service", "manager", "handler"), 0.2),
}
#: Keywords of the domains of the documents in the test tables.
DOMAINS = {"messaging": ("queue", "stream", "event", "message"), "storage": ("shard", "replica", "segment", "journal"), "security": ("token", "secret", "password", "session"), "graph": ("graph", "vertex", "edge", "ontology")}


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def cyclomatic(text: Column) -> Column:
    """1 + decision points: branching words and logical operators, counted in the whole text."""
    return F.lit(1) + count_of(text, r"\b(?:if|elif|for|while|case|catch|except)\b") + count_of(text, r"&&|\|\|")


def maintainability(lines: Column, complexity: Column) -> Column:
    """max(0, 171 - 5.2 ln(lines) - 0.23 complexity)"""
    return F.greatest(F.lit(0.0), 171 - 5.2 * F.log(F.greatest(lines, F.lit(1)).cast("double")) - 0.23 * complexity)


def debt(complexity: Column, cognitive: Column) -> Column:
    return F.greatest(F.lit(0.0), (complexity - 10) * 0.5 + (cognitive - 15) * 0.3)


def declarations(files: DataFrame, language: str, text: str) -> DataFrame:
    """`line_no, kind, name` of each declaration line beside the columns of the files; lines are exploded once."""
    keep = [c for c in files.columns if c not in (text, language)]
    lines = files.select(*keep, F.col(language).alias("_l"), F.posexplode(F.split(text, "\n")).alias("_n", "_line"))
    found = F.coalesce(
        *(
            F.when((F.col("_l") == lang) & F.col("_line").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("_line", pattern, 1).alias("name")))
            for lang, kinds in DECLARATIONS.items() for kind, pattern in kinds.items()
        )
    )
    return lines.withColumn("_d", found).where("_d is not null").select(*keep, (F.col("_n") + 1).alias("line_no"), "_d.kind", "_d.name")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words))


def size_tier(n: Column) -> Column:
    bounds = ((500, "tiny"), (2_000, "small"), (10_000, "medium"), (50_000, "large"), (100_000, "huge"))
    return reduce(lambda c, b: c.when(n < b[0], b[1]), bounds[1:], F.when(n < bounds[0][0], bounds[0][1])).otherwise("vast")


#: Decision points of the languages; each hit adds one to the cyclomatic complexity.
DECISIONS = {
    "typescript": r"\b(?:if|case|while|do|for)\b|\?(?![.?:])|&&|\|\|", "javascript": r"\b(?:if|case|while|do|for)\b|\?(?![.?:])|&&|\|\|", "python": r"\b(?:if|elif|while|for|try|with)\b", "java": r"\b(?:if|else|while|for|switch|case|catch)\b|\?",
    "go": r"\b(?:if|else|for|switch|case|select)\b", "rust": r"\b(?:if|while|for|loop|match)\b|\?;|\.unwrap\(|\.expect\(|&&|\|\|", "cpp": r"\b(?:if|for|while|do|switch|catch|throw)\b|&&|\|\||\?",
}
#: Languages whose cognitive complexity is taken as four fifths of the cyclomatic one.
_SHARED = ("java", "go")


def complexity(language: Column, text: Column) -> Column:
    """Cyclomatic complexity of a text in its language, null for other languages."""
    return reduce(lambda c, kv: c.when(language == kv[0], 1 + count_of(text, kv[1])), list(DECISIONS.items())[1:], F.when(language == "typescript", 1 + count_of(text, DECISIONS["typescript"])))


def cognitive(language: Column, text: Column) -> Column:
    cc = complexity(language, text)
    return F.when(language.isin(*_SHARED), F.floor(cc * 0.8)).otherwise(cc + count_of(text, r"\b(?:try|catch|except)\b"))


def calls(files: DataFrame, text: str) -> DataFrame:
    """`line_no, receiver, name` of the calls in each line; the receiver is null for plain functions, `new` for constructors."""
    keep = [c for c in files.columns if c != text]
    lines = files.select(*keep, F.posexplode(F.split(text, "\n")).alias("_n", "_line")).where(F.contains("_line", F.lit("(")))
    found = F.regexp_extract_all("_line", F.lit(r"(new\s+[A-Z]\w*|(?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*)\("), F.lit(1))
    rows = lines.select(*keep, (F.col("_n") + 1).alias("line_no"), F.explode(found).alias("_c"))
    plain = ~F.col("_c").isin("if", "for", "while", "switch", "catch", "return", "function", "def", "func", "elif", "and", "or", "not", "in", "print")
    made = F.col("_c").startswith("new ")
    return rows.where(plain).select(
        *keep, "line_no", F.when(made, "new").otherwise(F.nullif(F.regexp_extract("_c", r"^(\w+)\.", 1), F.lit(""))).alias("receiver"), F.regexp_extract("_c", r"(\w+)$", 1).alias("name")
    )


def python_ast(files: DataFrame, text: str) -> DataFrame:
    """Classes, functions and imports of Python texts by their syntax trees: `kind, name, line_no, end_line, parent, is_async`.

    Texts that do not parse have none. The first column of the files is kept as `path`.
    """
    import ast
    import warnings
    from collections.abc import Iterator

    import pyarrow as pa

    def facts(source: str) -> list[tuple]:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        out, stack = [], [(tree, None)]
        while stack:
            node, parent = stack.pop()
            for child in ast.iter_child_nodes(node):
                inner = parent
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                    out.append((kind, child.name, child.lineno, child.end_lineno, parent, isinstance(child, ast.AsyncFunctionDef)))
                    inner = child.name
                elif isinstance(child, ast.Import | ast.ImportFrom):
                    names = [a.name for a in child.names] if isinstance(child, ast.Import) else ["." * child.level + (child.module or "")]
                    out += [("import", n, child.lineno, child.end_lineno, parent, False) for n in names]
                stack.append((child, inner))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
        names = ["path", "kind", "name", "line_no", "end_line", "parent", "is_async"]
        for batch in batches:
            found = [(p, *f) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in facts(t or "")]
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return files.select(F.col(files.columns[0]).cast("string"), text).mapInArrow(rows, "path string, kind string, name string, line_no int, end_line int, parent string, is_async boolean")


#: Marks that people leave in generated files.
HAND_MARKS = ("manually", "custom", "hand-written", "handwritten", "edited by", "modified by", "todo", "fixme", "note:")


def outline(text: Column) -> Column:
    """Counts of what a text seems to declare, whatever its language: functions, classes, imports, exports and parameters."""
    n = lambda p: count_of(text, p).cast("bigint")
    return F.struct(
        n(r"(?m)^[ \t]*(?:export )?(?:async )?(?:def|func|function) [A-Za-z_]").alias("n_functions"), n(r"(?m)^[ \t]*(?:export )?(?:public )?(?:abstract )?class [A-Za-z_]").alias("n_classes"),
        n(r"(?m)^[ \t]*(?:import|from) ").alias("n_imports"), n(r"(?m)^export ").alias("n_exports"), n(r"(?m)@param ").alias("n_params"),
    )


def dependency_class(module: Column, builtin: tuple[str, ...]) -> Column:
    """internal for relative names and those of the own tree, builtin for listed ones, else external."""
    return F.when(module.rlike(r"^\.|^mod\.example/"), "internal").when(F.split_part(module, F.lit("."), F.lit(1)).isin(*builtin), "builtin").otherwise("external")


def hand_modified(text: Column) -> Column:
    """Whether a text holds one of HAND_MARKS, without regard to case."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in HAND_MARKS))
