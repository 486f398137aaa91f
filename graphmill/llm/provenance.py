"""Generated, minified, vendored and data files, told apart from hand-written ones.

1. The token classes of a file are compressed by Re-Pair: the most frequent pairs become rules, round by round. What a
   tool wrote reuses few rules very often and shrinks to a small part of its length, far below what a hand-written file
   of that length does. Literals that are near-incompressible (no words, hardly a repeated character pair) make a blob of
   a file that consists of them.
2. A phrase, a specific line without blanks, that stands in several places is a rule of the grammar of the whole corpus.
   Phrases are counted by repository and joined by hash; a file most of whose phrases stand in one library file, or
   nearly all in several repositories, was taken over.
3. Marks that tools leave (remarks, names, folders, metadata) decide only what grammar and rules leave open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table
from .lexing import lexer

KINDS = ("vendored", "generated", "minified", "data")
#: What decided: the grammar of the file, its literals, rules shared with a library or repositories, long lines, a mark, a path.
EVIDENCE = ("grammar", "literals", "rules", "lines", "mark", "path")
#: Rules are numbered above all code points. A pair is replaced together with one that is at most so much more frequent.
FIRST_RULE = 0x110000
NEARLY = 0.7
#: Part of a file's phrases that stand in one library file, or in so many repositories, of a file that was taken over.
LIBRARY_PART = 0.6
LEAST_PHRASES = 3
MANY_PART = 0.9
MANY_OWNERS = 3
LEAST_SHARED = 6
#: Part of the text in near-incompressible literals, alone and beside a grammar of few rules.
DENSE_PART = 0.7
DENSE_RECORDS = 0.5

#: Folders and names that tools and package managers use, and remarks that tools leave.
_THIRD_PARTY = {"vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "deps", "external", "extern", "bower_components", "node_modules", "site-packages", "Pods", "jspm_packages"}
_MADE = {"generated", "gen", "autogen", "__generated__", "generated-sources", "codegen-out"}
_MADE_NAME = re.compile(r"_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|ts|js)$|(?:Generated|OuterClass|Grpc)\.java$|[._](?:generated|gen|g)\.\w+$|_string\.go$", re.A)
_LOCK_NAME = re.compile(r"(?:^|[-_.])lock\.(?:json|ya?ml)$|\.lock(?:file)?$|^(?:go\.sum|(?:npm-)?shrinkwrap\.(?:json|ya?ml))$")
_SMALL_NAME = re.compile(r"[.\-]min\.(?:js|mjs|css)$")
_REMARK = re.compile(r"\s*(?://|#|/?\*|--|<!--|;)")
_SAYS_MADE = re.compile(
    r"(?i)\bcode generated by\b|@generated\b|\bauto-?generated (?:file|by|from|code)\b|<auto-?generated>|\bautomatically (?:created|generated|produced)\b|\bgenerated (?:automatically|by the [\w ]+ compiler)\b|\bdo not (?:edit|modify)\b"
)
_HEADER = re.compile(
    r"\s*(?:(?P<remark>/\*(?:[^*]|\*(?!/))*\*/|<!--[\s\S]*?-->|(?://|#|/?\*|--|<!--|;)[^\n]*)"
    r"|(?:import|from\s+[\w.]+\s+import)\s*\([^)]*\)|import\s[^;\"'()=]*\sfrom\b[^\n]*|(?:package|import|from|using)\s[^\n]*|([\"'])use \w+\2;?|<\?[\s\S]*?\?>|<!(?i:doctype)[^>]*>"
    r"|[rRuU]?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''))"
)
_LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "java": "java", "go": "go", "json": "json"}
_PLAIN_LINE = re.compile(r"\s*(?://|#|\*|/\*|return\b|for\b|if\b|else\b|default\b|import\b|from\b|package\b|case\b|switch\b|break\b|try\b|[})\]])")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|\b(?:0x[0-9a-fA-F]+|\d+)\b")


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of rising places, those that do not overlap: in a run of neighbours every other one."""
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    run = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    return at[run % 2 == 0]


def repair(kinds: str, limit: float = float("inf")) -> tuple[int, int]:
    """(length of the grammar, longest reuse of a rule) of a string after Re-Pair, which ends when no pair occurs three times.

    Each round counts all pairs and replaces, by a new rule each, the most frequent one and those nearly as frequent
    that share no symbol with one before. Rarer pairs wait for a later round, so that the grammar is about as short as
    with one pair a round. Rules cost two symbols each.

    Two neighbours whose pair occurs less than three times stay apart for good, since no later pair across their border
    can occur more often. Their number and the rules so far are a lower bound of the length; once it reaches `limit`, the
    bound is returned instead, which tells as well that the grammar is not shorter.
    """
    codes, symbol, most = np.frombuffer(kinds.encode("utf-32-le"), np.uint32).astype(np.int64), FIRST_RULE, 0
    while len(codes) > 5:
        places = (codes[:-1] << 32) | codes[1:]
        pairs, counts = np.unique(places, return_counts=True)
        least_length = 1 + int(counts[counts < 3].sum()) + 2 * (symbol - FIRST_RULE)
        if least_length >= limit:
            return least_length, most
        often = np.flatnonzero(counts >= 3)
        often = often[np.argsort(-counts[often], kind="stable")]
        used: set[int] = set()
        chosen: list[int] = []
        least = 3.0
        for pair, n in zip(pairs[often].tolist(), counts[often].tolist(), strict=True):
            if n < least:
                break
            a, b = pair >> 32, pair & 0xFFFFFFFF
            if a in used or b in used:
                continue
            if a == b:
                n = len(_every_other(np.flatnonzero(places == pair)))
                if n < least:
                    continue
            if not chosen:
                least = max(3.0, n * NEARLY)
            used |= {a, b}
            chosen.append(pair)
            most = max(most, n)
        if not chosen:
            break
        rules = np.sort(np.array(chosen))
        to = np.minimum(np.searchsorted(rules, places), len(rules) - 1)
        at = _every_other(np.flatnonzero(rules[to] == places))
        codes[at] = symbol + to[at]
        codes = np.delete(codes, at + 1)
        symbol += len(rules)
    return len(codes) + 2 * (symbol - FIRST_RULE), most


def made_by_grammar(kinds: str) -> bool:
    """Whether the token classes shrink as only those of generated or minified code do.

    The grammar of a hand-written file grows about with the root of its length. On scale 0.1 it had 6.8 times the root
    or more, generated files at most 3.4 times; from some 14,000 tokens on a share of the length decides.
    """
    n = len(kinds)
    if n < 250 or sum(map(kinds.count, "fw")) < 8:
        return False
    limit = n * max(0.04, 4.8 / n**0.5)
    return repair(kinds, limit)[0] < limit


def dense_part(text: str) -> float:
    """Share of a file's characters, without blanks and remarks, that stand in dense literals or tables of numbers."""
    dense = total = 0
    last = 0
    for m in _LITERAL.finditer(text):
        found = m[0]
        total += len(text[last : m.start()].replace(" ", "").replace("\n", "").replace("\t", ""))
        last = m.end()
        if found[0] in "/#":
            continue
        total += len(found)
        if found[0].isdigit():
            dense += len(found) + 1
        elif len(found) >= 26 and " " not in found[1:-1].strip() and _incompressible(found[1:-1]):
            dense += len(found)
    total += len("".join(text[last:].split()))
    return dense / total if total else 0.0


def _incompressible(text: str) -> bool:
    """Whether the character pairs hardly repeat: no pair is much more frequent than chance allows."""
    part = text[text.find(",") + 1 :] if text.startswith("data:") else text
    if "-----BEGIN" in part or "://" in part or not re.search(r"\d", part):
        return False
    pairs = Counter(zip(part, part[1:], strict=False))
    return max(pairs.values(), default=0) <= 3 + len(part) // 64


def is_minified(text: str) -> bool:
    """Whether most of the text stands in very long lines of code (remarks and single literals are no code)."""
    long = 0
    for line in text.split("\n"):
        if len(line) > 250 and not _REMARK.match(line) and sum(map(line.count, ";{}(),:=")) > len(line) / 12:
            code = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", line)
            if len(code) > 200 and code.count(" ") < len(code) / 8:
                long += len(line)
    return long > 0.6 * len(text)


def _header(text: str) -> Iterator[str]:
    """The remarks before the first code; imports, package lines, directives and a doc string do not end the header."""
    at = 1 if text[:1] == "\ufeff" else 0
    while m := _HEADER.match(text, at):
        at = m.end()
        if m["remark"]:
            yield m["remark"]


def _footer(text: str, language: str | None) -> Iterator[str]:
    """The remarks after the last code. In a language with a lexer that tells remarks from what stands in literals."""
    if language:
        of = lexer(language)
        for token in reversed(of.tokens(text)):
            if token != "\n" and of.classes[token]:
                return
            yield token
        return
    end = len(text.rstrip())
    while end > 0:
        at = next((text.rfind(a, 0, end) for z, a in (("*/", "/*"), ("-->", "<!--")) if text.endswith(z, 0, end)), -1)
        if at < 0:
            at = text.rfind("\n", 0, end) + 1
            if not _REMARK.match(text, at, end):
                return
        yield text[at:end]
        end = len(text[:at].rstrip())


def says_made(text: str, language: str | None = None) -> bool:
    """Whether a remark before or after all code says that a tool wrote the file; string literals do not count."""
    low = text.lower()
    if not any(map(low.__contains__, ("generated", "automatically", "do not edit", "do not modify"))) or not _SAYS_MADE.search(text):
        return False
    return any(map(_SAYS_MADE.search, _header(text))) or any(map(_SAYS_MADE.search, _footer(text, language)))


def phrases(text: str) -> set[str]:
    """The lines of a text that are specific enough to tell where it comes from, without blanks."""
    return {"".join(line.split()) for line in text.split("\n") if len(line) > 14 and not _PLAIN_LINE.match(line)}


def by_path(path: str | None, metadata: dict[str, str]) -> str | None:
    """The kind that folders, the name and the metadata of a file tell."""
    parts = (path or "").split("/")
    name = parts[-1]
    if _THIRD_PARTY.intersection(parts[:-1]) or (metadata.get("origin") or "").startswith("third"):
        return "vendored"
    if (
        _LOCK_NAME.search(name) or _MADE_NAME.search(name) or _MADE.intersection(parts[:-1]) or metadata.get("generated") == "true" or metadata.get("generator")
        or (metadata.get("origin") or "").startswith("codegen")
    ):
        return "generated"
    return "minified" if _SMALL_NAME.search(name) else None


def by_text(text: str, language: str | None) -> tuple[str | None, str | None]:
    """(kind, evidence) of a text: the grammar first, then literals, lines and remarks.

    Configuration (json and what has no lexer) is a list of records by nature; there a small grammar counts only
    beside literals that are mostly near-incompressible, as in the digests of a lock file.
    """
    if language and language != "json" and made_by_grammar(lexer(language).kinds(text)):
        return "minified" if is_minified(text) else "generated", "grammar"
    dense = dense_part(text) if language else 0.0
    if language == "json":
        limit = 0.1 * text.count('"')
        if dense >= DENSE_RECORDS and repair(lexer(language).kinds(text), limit)[0] < limit:
            return "generated", "grammar"
    elif dense >= DENSE_PART:
        return "data", "literals"
    if language and language != "json" and is_minified(text):
        return "minified", "lines"
    return ("generated", "mark") if says_made(text, language) else (None, None)


def verdict(path: str | None, text: str | None, metadata: dict[str, str]) -> tuple[str | None, str | None]:
    """(kind, evidence) of a file by itself. A third-party folder names the kind even where the text was judged first."""
    told = by_path(path, metadata)
    kind, evidence = by_text(text, _LANGUAGE.get((path or "").rpartition(".")[2].lower())) if text else (None, None)
    return (told if told == "vendored" else kind or told), evidence or (told and "path")


def _hash(phrase: str) -> int:
    h = xxhash.xxh64_intdigest(phrase.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def phrase_hashes(text: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([[_hash(p) for p in phrases(t or "")] for t in texts.to_pylist()], pa.list_(pa.int64()))

    return cut(text)


_TOLD = pa.struct([("kind", pa.string()), ("evidence", pa.string()), ("phrases", pa.list_(pa.int64()))])


def file_verdict(path: Column, text: Column, metadata: Column) -> Column:
    """`kind` (one of KINDS, or null), `evidence` and the hashes of the `phrases` of a file by itself.

    Null paths, texts and metadata tell nothing; an empty text is judged by its path and metadata alone.
    """

    @F.arrow_udf("struct<kind:string,evidence:string,phrases:array<bigint>>")
    def judge(paths: pa.Array, texts: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(paths.to_pylist(), texts.to_pylist(), data.to_pylist(), strict=True)
        out = []
        for path, text, told in rows:
            kind, evidence = verdict(path, text, dict(told or ()))
            out.append({"kind": kind, "evidence": evidence, "phrases": [_hash(p) for p in phrases(text or "")]})
        return pa.array(out, _TOLD)

    return judge(path, text, metadata)


def library_rules(library: DataFrame) -> DataFrame:
    """`h, library`: phrases of one library file only."""
    rows = library.where("source_code is not null").select("file_key", F.explode(phrase_hashes(F.col("source_code"))).alias("h")).distinct()
    return rows.groupBy("h").agg(F.min("file_key").alias("library"), F.count(F.lit(1)).alias("n")).where("n = 1").select("h", "library")


def shared_rules(files: DataFrame, library: DataFrame) -> DataFrame:
    """`k1, k2, from_library, from_many`: how many phrases of a file stand in the library file that has most of them, and
    how many in MANY_OWNERS repositories or more (a missing repository is one of its own).

    Owners are counted after the phrases were made distinct by repository, so that a phrase of a third of all files is a
    row a repository; the join back carries hashes alone and is left to the engine's split of skewed keys.
    """
    stands = files.select("k1", "k2", F.coalesce("repository_id", F.lit("")).alias("owner"), F.explode("phrases").alias("h"))
    many = stands.groupBy("h").agg(F.count_distinct("owner").alias("owners")).where(F.col("owners") >= MANY_OWNERS)
    rules = many.join(library_rules(library), "h", "full_outer")
    counted = stands.join(rules, "h").groupBy("k1", "k2", "library").agg(F.count(F.lit(1)).alias("n"), F.count("owners").alias("m"))
    return counted.groupBy("k1", "k2").agg(F.max(F.when(F.col("library").isNotNull(), F.col("n"))).alias("from_library"), F.sum("m").alias("from_many"))


def judged_files(entities: DataFrame, library: DataFrame) -> DataFrame:
    """`entity_id, version, kind, evidence` of every file version, both null where it is hand-written.

    Of a version delivered more than once the last delivery counts. An empty table gives no rows.
    """
    files = entities.where("entity_type = 'File'").select("entity_id", "version", "repository_id", "ingested_at", "file_path", "source_code", "metadata")
    told = files.withColumn("v", file_verdict(F.col("file_path"), F.col("source_code"), F.col("metadata")))
    last = told.groupBy("entity_id", "version").agg(F.max_by(F.struct("repository_id", "v"), "ingested_at").alias("r")).select(
        "entity_id", "version", F.xxhash64("entity_id", "version").alias("k1"), F.xxhash64("version", "entity_id").alias("k2"), "r.repository_id", "r.v.*"
    )
    judged = stored(last, "judged")
    n = F.size("phrases")
    many = (n >= LEAST_SHARED) & (F.col("from_many") >= n * MANY_PART) & ~F.col("evidence").eqNullSafe("grammar")
    taken = F.coalesce(F.col("from_library") >= F.greatest(F.lit(LEAST_PHRASES), n * LIBRARY_PART), F.lit(False)) | F.coalesce(many, F.lit(False))
    return judged.join(shared_rules(judged, library), ["k1", "k2"], "left").select(
        "entity_id", "version", F.when(taken, "vendored").otherwise(F.col("kind")).alias("kind"), F.when(taken, "rules").otherwise(F.col("evidence")).alias("evidence")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_kinds(spark, d).where("kind is not null").select("entity_id", "version")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return judged_files(table(spark, d, "code_entities"), table(spark, d, "library_files"))


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds}
SQL: dict[str, str] = {}
