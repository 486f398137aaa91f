"""Credentials in source and configuration files, found corpus-wide and redacted.

1. All quoted literals are indexed over the whole corpus by their hash and repository, in one pass that also cuts out the
   candidates: literals with a context that suggests a credential (the name they are assigned to, a URL, a header, a
   sign-in call, a remark, or a format of their own).
2. What many repositories hold, wherever it stands, is a placeholder and suppressed; of the rest a value is confirmed if
   its structure is that of a credential.
3. Every file is scanned again for the confirmed values. Each has an anchor, its most telling run of letters and digits.
   A Bloom filter of fixed size over the anchors lets only files pass that may hold one; an exact join by anchor gives
   each of them its own few values, and an automaton over these finds their places.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored, table

#: A value that so many repositories and such a share of all hold is a placeholder, unless its format tells that it is none.
SHARED_BY = 8
SHARED_PART = 0.05
#: Bits of the filter over the anchors, a power of two, and bits set for each. A full filter lets more files through to the join.
BITS = 1 << 27
PROBES = 4
MASK = "REDACTED_SECRET"

#: What names of credentials end with, and formats that tell a credential by themselves.
_NAME = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:api|access|private|signing|auth|encryption|account|secret)[_.\- ]?key|pat|apikey)$", re.I)
_FORMAT = re.compile(
    r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{18,}|xox[abpors]-[\w-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:\\n|\\r|[\w+/=:,\- \t\r\n.\"'\\])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\\n|\\r|\s)*[\w+/=]{16,})+")
#: A line without any of these holds no candidate (compared in lower case).
_TRIGGERS = (
    "pass", "pwd", "secret", "token", "cred", "key", "pat", "://", "bearer ", "basic ", "login", "connect", "client", "session", "auth", "sign", "open", " / ",
    "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "k_live_", "k_test_", "aiza", "npm_", "pypi-", "eyj",
)
_STRING = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"
_ASSIGNED = re.compile(
    rf"([A-Za-z_][\w.\-]*)[\"']?\s*(?:\:\s*[\w.<>\[\]]+\s*)?(?:=>|:=|=|:)\s*(?:[rbuf]{{0,2}})({_STRING}(?:\s*[+.]?\s*{_STRING})*)"
)
#: The same over line ends: after the name or operator, and between parts that an operator, a backslash or a bracket joins.
_WRAPPED = re.compile(
    rf"([A-Za-z_][\w.\-]*)[\"']?\s*(?:\:\s*[\w.<>\[\]]+\s*)?(?:=>|:=|=|:)\s*(?:\(\s*[rbuf]{{0,2}}({_STRING}(?:\s*[+.]?\s*{_STRING})*)|(?:\\\r?\n\s*)?[rbuf]{{0,2}}({_STRING}(?:(?:\s*[+.]\s*|\s*\\\r?\n\s*|[ \t]*){_STRING})*))(?!\s*:)"
)
_JOINT = re.compile(r"([\"'`](?:[ \t\r+.\\]*\n)+[ \t+.]*[rbuf]{0,2}[\"'`])")
_WORD = re.compile(r"[A-Za-z_][\w.\-]*")
_GOES_ON = re.compile(r"\s*(?:[\"'`+.=:(\\]|[rbuf]{1,2}[\"'])")
_BARE = re.compile(r"^\s*[+\-]?\s*(?:export\s+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*[:=]\s*([^\s\"'`;,(){}\[\]<>$][^\s\"'`;,(){}\[\]<>]*)\s*$")
_FALLBACK = re.compile(rf"[\"']?([A-Za-z_][\w.\-]*)[\"']?\s*\]?\s*\)?\s*(?:,|\|\||\?\?|\bor\b|\bif\b)\s*({_STRING})")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@\"'`<>]*:([^\s@/\"'`<>]+)@[\w\[]")
_HEADER = re.compile(r"(?i)\b(?:bearer|token|basic)\s+([A-Za-z0-9+/_.\-]{12,}={0,2})")
_CALL = re.compile(rf"(?i)\b\w*(?:login|connect|client|session|auth|sign_?in|open)\w*\(\s*({_STRING}(?:\s*,\s*{_STRING})+)\s*\)")
_REMARK = re.compile(r"(?:#|//|\*|--|;)\s.*?\S+ / (\S{6,})\s*(?:\*/)?$")
_PART = re.compile(_STRING)

#: What stands in for a credential.
_PLACEHOLDER = re.compile(
    r"(?i)\$\{|\$\(|\{\{|^\$|^%[(\w]|<[^>]*>|^[x*.#•\-_]+$|your|change.?me|replace|example|sample.?key|place.?holder|dummy|redacted|to.?be.?set|set.?me|todo|^file:|^env:|^vault|^secret:|^arn:|^/(?:[a-z][a-z_.\-]*/)*[a-z_.\-]+$|^/(?:[a-z][\w.\-]*/)+[\w.\-]*\.[a-z]+$|^\.{1,2}/"
    r"|^(?:password|passwd|secret|token|none|null|true|false|undefined|admin|root|guest|test|default|foo|bar|string|user|pass|key)\d{0,3}$|(?<![a-z])(?:must|invalid|required|missing)(?![a-z])|\{\w[^{}]*\}"
)
#: What stands in a sentence but not in a passphrase, and what a word for a credential is made of.
_SENTENCE = re.compile(r"(?i)\b(?:an?|and|are|as|be|by|can|could|do|enter|for|from|has|have|if|in|is|it|no|not|of|on|or|please|that|the|this|to|too|use|was|were|when|will|with)\b|[,:?]|\.(?:\s|$)")
_MADE_OF = re.compile(r"pass|token|secret|key|auth|user|name|cred|login|account|admin|value|string")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def structured(value: str, context: str) -> bool:
    """Whether the value can be a credential; context is url, name (its name or place says that it is one) or none."""
    if "PRIVATE KEY" in value:
        return True
    if len(value) < 6 or _PLACEHOLDER.search(value) or _UUID.match(value):
        return False
    if _FORMAT.match(value):
        return True
    if context == "none" or "://" in value or len(set(value)) < 5:
        return False
    if re.search(r"\s", value):
        words = value.split(" ")
        return context == "name" and 3 <= len(words) <= 12 and all(len(w) > 1 and re.fullmatch(r"[\w\-!.]+", w) for w in words) and not _SENTENCE.search(value)
    digits, lower, upper = (bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    special = bool(re.search(r"[^\w.\-/ ]", value))
    if not (lower or upper):
        return False
    if digits and re.fullmatch(r"v?\d+(?:\.\d+)+[\w.\-]*|[a-z]+(?:[_.\-]?[a-z]+)*[_.\-]?\d{1,3}", value):
        return False
    if digits or special:
        return digits + lower + upper + special >= 2
    capitals = len(re.findall("[A-Z]", value))
    if context == "url":
        return len(value) >= 8 and lower and upper and not re.fullmatch("[A-Z][a-z]+", value)
    return lower and (len(value) >= 9 and len(value) < 4 * capitals or context == "name" and len(value) >= 16 and value.isalpha() and not capitals and not _MADE_OF.search(value))


def _name_says(name: str) -> bool:
    return bool(_NAME.search(name.rstrip("0123456789_.-")))


def _hot_lines(text: str) -> dict[str, set[int]]:
    """Line to where it begins, of the lines with a trigger."""
    low, lines = text.replace("\u0130", "I").lower(), {}
    for trigger in _TRIGGERS:
        at = low.find(trigger)
        while at >= 0:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            start = text.rfind("\n", 0, at) + 1
            lines.setdefault(text[start:end], set()).add(start)
            at = low.find(trigger, end)
    return lines


def _wrapped(text: str, line: str, starts: set[int]) -> Iterator[str]:
    """The literals that are assigned to a name in the line and stand, or go on, in the lines below."""
    if line.rstrip()[-1:] in ",;{})]":
        return
    for start in starts:
        if _GOES_ON.match(text, start + len(line)):
            for m in _WORD.finditer(line):
                if _name_says(m[0]) and (found := _WRAPPED.match(text, start + m.start())) and "\n" in found[0]:
                    yield found[2] or found[3]


def candidates(text: str) -> set[tuple[str, str, str]]:
    """(value, surface, context) of the literals of a file whose place suggests a credential.

    The value is what the program sees, the surface the characters of the file from the value's first to its last;
    the two differ where a literal is put together from parts.
    """
    found: list[tuple[str, str, str]] = [(m[0].replace("\\n", "\n"), m[0], "name") for m in _PEM.finditer(text)]
    for line, starts in _hot_lines(text).items():
        found += [(m[0], m[0], "none") for m in _FORMAT.finditer(line)]
        found += [(m[1], m[1], "url") for m in _URL.finditer(line)]
        found += [(m[1], m[1], "name" if re.search(r"\d", m[1]) else "none") for m in _HEADER.finditer(line)]
        for m in (*_ASSIGNED.finditer(line), *_FALLBACK.finditer(line)):
            if "PRIVATE KEY" not in m[2] and _name_says(m[1]):
                parts = [p[1:-1] for p in _PART.findall(m[2])]
                found.append(("".join(parts), m[2][1:-1], "name"))
        for whole in _wrapped(text, line, starts):
            if "PRIVATE KEY" not in whole:
                found.append(("".join(p[1:-1] for p in _PART.findall(whole)), whole[1:-1], "name"))
        if (m := _BARE.match(line)) and _name_says(m[1]):
            found.append((m[2], m[2], "name"))
        for m in _CALL.finditer(line):
            args = [p[1:-1] for p in _PART.findall(m[1])]
            if len(args) > 2:
                found.append((args[-1], args[-1], "name"))
        if m := _REMARK.search(line):
            found.append((m[1], m[1], "name"))
    return {c for c in found if len(c[0]) > 5}


def _files(entities: DataFrame) -> DataFrame:
    return entities.where("entity_type = 'File' and length(source_code) > 0").select("entity_id", "version", "repository_id", "ingested_at", "source_code")


_QUOTED = re.compile(r"\"([^\"\n\\]{6,})\"|'([^'\n\\]{6,})'|`([^`\n\\]{6,})`")
_INDEX = pa.schema([("h", pa.int64()), ("repository_id", pa.string()), ("value", pa.string()), ("surface", pa.string()), ("context", pa.string())])


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def index_literals(files: DataFrame) -> DataFrame:
    """`h, repository_id, value, surface, context`: the hash of each literal by repository, the rest for candidates only.

    A missing repository counts as one of its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple] = set()
            hashes: dict[str, int] = {}
            for repo, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                owner = repo or ""
                told = candidates(text)
                values = {v for v, _, _ in told}
                for parts in _QUOTED.findall(text):
                    values.add(parts[0] or parts[1] or parts[2])
                for value in values:
                    if value not in hashes:
                        hashes[value] = _hash(value)
                    rows.add((hashes[value], owner, None, None, None))
                rows.update((hashes[v], owner, v, s, c) for v, s, c in told)
            columns = zip(*rows, strict=True) if rows else [()] * len(_INDEX.names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _INDEX.types, strict=True)], _INDEX.names)

    return files.select("repository_id", "source_code").mapInArrow(cut, "h bigint, repository_id string, value string, surface string, context string")


def confirmed(literals: DataFrame, shared_by: float = SHARED_BY) -> DataFrame:
    """Distinct `surface` of the candidates whose value fewer than `shared_by` repositories hold and whose structure is
    that of a credential; the value is one more surface.

    Private keys and values of a format of their own are kept however many share them. (hash, repository) is made
    distinct before it is counted, and of a value only its few different surfaces are gathered, so that a literal in a
    third of all files is a few rows a repository.
    """
    told = F.when(F.col("value").isNotNull(), F.struct("value", "surface", "context"))
    known = literals.groupBy("h").agg(F.count_distinct("repository_id").alias("owners"), F.collect_set(told).alias("told")).where(F.size("told") > 0)
    rows = known.select("owners", F.explode("told").alias("t")).select("owners", "t.*")
    rare = rows.where((F.col("owners") < shared_by) | F.col("value").contains("PRIVATE KEY") | F.col("value").rlike(rf"\A{_FORMAT.pattern}"))

    @F.arrow_udf("boolean")
    def fits(values: pa.Array, contexts: pa.Array) -> pa.Array:
        return pa.array([structured(v, c) for v, c in zip(values.to_pylist(), contexts.to_pylist(), strict=True)], pa.bool_())

    return rare.where(fits("value", "context")).select(F.explode(F.array("surface", "value")).alias("surface")).distinct()


class Scanner:
    """Finds some surfaces in a text; a match must not continue a longer word."""

    def __init__(self, surfaces: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for s in surfaces:
            self.automaton.add_word(s, len(s))
        if surfaces:
            self.automaton.make_automaton()
        self.any = bool(surfaces)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Disjoint (start, end), longest first where matches overlap."""
        if not self.any:
            return []
        hits = []
        for end, size in self.automaton.iter(text):
            start, end = end - size + 1, end + 1
            before, after = text[start - 1 : start], text[end : end + 1]
            if (before.isalnum() and text[start].isalnum() and text[start - 2 : start] != "\\n") or (after.isalnum() and text[end - 1].isalnum()):
                continue
            hits.append((start, end))
        return merged(hits)


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The hits without those that overlap a longer one or repeat it."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(set(hits), key=lambda h: (h[0], -h[1])):
        if not kept or start >= kept[-1][1]:
            kept.append((start, end))
        elif end - start > kept[-1][1] - kept[-1][0]:
            kept[-1] = (start, end)
    return kept


_RUN = re.compile(r"[A-Za-z0-9]+")
_RUN_AFTER = re.compile(r"\\[nrt]([A-Za-z0-9]+)")


def anchor(surface: str) -> str:
    """The run of letters and digits that tells a surface best: long, with digits, in both cases."""
    return max(_RUN.findall(surface), key=lambda r: (len(r) + 4 * any(c.isdigit() for c in r) + 2 * (not r.islower() and not r.isupper()), r), default="")


def anchors(surfaces: DataFrame) -> DataFrame:
    """`anchor, surface`, the anchor as its hash. A surface without letters and digits is none of a credential and left out."""

    @F.arrow_udf("bigint")
    def tell(values: pa.Array) -> pa.Array:
        return pa.array([_hash(a) if (a := anchor(v)) else None for v in values.to_pylist()], pa.int64())

    return surfaces.select(tell("surface").alias("anchor"), "surface").where("anchor is not null")


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row a probe."""
    u = h.astype(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    return np.stack([((u + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)])


def bloom(named: DataFrame, bits: int = BITS) -> np.ndarray:
    """A Bloom filter over `anchor`, as bytes: never larger than `bits`, whatever the number of anchors.

    Bits are set in the tasks and combined by the eight-byte word, so that at most bits / 64 rows come to the driver.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(1, at & 63))], ["word", "mask"])

    words = named.select("anchor").mapInArrow(fill, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(max(1, bits >> 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _holds(filled: np.ndarray, bits: int, words: list[str]) -> set[str]:
    """The words that may be anchors."""
    at = _places(np.array([_hash(w) for w in words], np.int64), bits)
    found = ((filled[at >> 6] >> (at & 63)) & 1).all(axis=0)
    return {words[i] for i in np.flatnonzero(found)}


def scan(files: DataFrame, surfaces: DataFrame, bits: int = BITS) -> DataFrame:
    """`entity_id, version, ingested_at, source_code, spans`, the places of all confirmed surfaces; files without any are left out.

    A file that passes the filter gives one row with its text and one for each anchor it may hold; the exact join with
    the surfaces is over these rows alone. No task holds more than the surfaces of its own files.
    """
    named = stored(anchors(surfaces), "anchors")
    filled = files.sparkSession.sparkContext.broadcast(bloom(named, bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            runs = []
            for row in rows:
                text = row["source_code"]
                runs.append({*_RUN.findall(text), *(_RUN_AFTER.findall(text) if "\\" in text else ())})
            every = list(set().union(*runs))
            hot = _holds(filled.value, bits, every) if every else set()
            out = []
            for row, own in zip(rows, runs, strict=True):
                if found := own & hot:
                    told = xxhash.xxh3_128_intdigest(repr((row["entity_id"], row["version"], row["ingested_at"], row["source_code"])).encode("utf-8", "surrogatepass"))
                    keys = {"k1": (told >> 64) - (1 << 63), "k2": (told & ((1 << 64) - 1)) - (1 << 63)}
                    out.append(row | keys)
                    out += [keys | {"anchor": _hash(word)} for word in found]
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("entity_id", pa.string()), ("version", pa.string()), ("ingested_at", pa.timestamp("us")), ("source_code", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("anchor", pa.int64())])
    rows = files.select("entity_id", "version", "ingested_at", "source_code").mapInArrow(hits, "entity_id string, version string, ingested_at timestamp_ntz, source_code string, k1 bigint, k2 bigint, anchor bigint")

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = [[{"start": a, "end": b} for a, b in Scanner(s).spans(t)] for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    own = rows.join(named, "anchor", "left").groupBy("k1", "k2").agg(
        F.max("entity_id").alias("entity_id"), F.max("version").alias("version"), F.max("ingested_at").alias("ingested_at"), F.max("source_code").alias("source_code"), F.collect_set("surface").alias("surfaces")
    )
    spans = find("source_code", "surfaces")
    return own.where(F.size("surfaces") > 0).select("entity_id", "version", "ingested_at", "source_code", spans.alias("spans")).where(F.size("spans") > 0)


def lines_of(text: str, spans: list[dict]) -> list[int]:
    """Lines, from 1, on which the spans begin; each once."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return sorted({1 + bisect_right(breaks, a - 1) for a, _ in merged([(s["start"], s["end"]) for s in spans])})


def redact(text: str, spans: list[dict]) -> str:
    """The text with MASK for each span. Line ends and the indentation inside of a span stay, so that all other
    lines keep their numbers and blocks their shape; so does what joins the parts of a literal over a line end."""
    out, at = [], 0
    for start, end in merged([(s["start"], s["end"]) for s in spans]):
        out.append(text[at:start])
        for n, piece in enumerate(_JOINT.split(text[start:end])):
            out.append(piece if n % 2 else re.sub(r"(?m)(?<=\S)[ \t]*\S.*$|\S[^\n\r]*", MASK, piece))
        at = end
    return "".join([*out, text[at:]])


def secret_files(entities: DataFrame, shared_by: int = SHARED_BY, shared_part: float = SHARED_PART, bits: int = BITS) -> DataFrame:
    """Files that hold confirmed credentials, with `spans`; one row per different delivery.

    Null and empty texts hold none; an empty table gives no rows; extra columns are ignored. Of repeated values in
    one file every place is reported. What is written on the way is deleted when the process ends.
    """
    files = _files(entities)
    owners = files.select(F.coalesce("repository_id", F.lit(""))).distinct().count()
    return scan(files, confirmed(index_literals(files), max(shared_by, shared_part * owners)), bits)


def found_lines(entities: DataFrame) -> DataFrame:
    """`entity_id, version, line_no`, distinct, for each line on which a credential begins."""

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([lines_of(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.list_(pa.int32()))

    lines = secret_files(entities).select("entity_id", "version", F.explode(numbers("source_code", "spans")).alias("line_no"))
    return lines.distinct()


def redacted_files(entities: DataFrame) -> DataFrame:
    """`entity_id, version, n_secrets, source_code` of the files that had credentials, which are masked now.

    Of a version delivered more than once the last delivery counts.
    """

    @F.arrow_udf("string")
    def mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([redact(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    done = secret_files(entities).select("entity_id", "version", "ingested_at", F.size("spans").alias("n_secrets"), mask("source_code", "spans").alias("source_code"))
    return done.groupBy("entity_id", "version").agg(F.max_by(F.struct("n_secrets", "source_code"), "ingested_at").alias("r")).select("entity_id", "version", "r.*")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return found_lines(table(spark, d, "code_entities"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted_files(table(spark, d, "code_entities"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
SQL: dict[str, str] = {}
