"""Source files that do not parse, found by lexers with a pushdown stack.

One pass over the token classes of a file keeps the open brackets on a stack, so that nesting costs nothing. A group
whose bracket closes is checked as a flat string against what its language never allows (an operator without operand,
two operands side by side, a statement without end, an else without its if, ...), then stands for one symbol in the
group around it. A bracket that closes nothing or stays open is unbalanced. Python and JSON files that pass are parsed by
the languages' own parsers afterwards; where such a parser gives up for lack of room the file is not flagged.
"""

from __future__ import annotations

import ast
import json
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .lexing import COARSE, lexer

LANGUAGES = ("python", "typescript", "javascript", "java", "go", "json")
REASONS = ("literal", "brackets", "tokens", "end", "empty", "parser")

_SYMBOL = {"(": "P", "[": "B", "{": "K"}
_WORDS = "fCkewbdvIxDjpcgrhyqzaW"


def _never(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts))


#: What no group of a script may contain; a line end counts where one operand follows another.
_SCRIPT_ANY = (
    r"[ins][ins]", r"[insB.]P[ins]", r"B[ins]", r"[o=|+?A.Q~@][,;)=]", r"[o*=|+?:][o=]", r"[,;:][.]", r",[;o=?:]", r"\.\n*[^i\n]", r"(?:^|[;K\n])iK",
    r"[dv]\n*(?![icBK\n])", r"[dv][ic](?![=:;,\nb~c])", r"f(?!\n*\*?\n*[ic]?[<P])", r"C(?![icKp\n])", r"k(?!\n*c?\n*P)", r"I(?=[;n\n])", r"Ii[.n]", r"Ii\n*$", r"e(?![\nKkPwicdvjfu;])", r"C[ic]:",
    r"@@", r"::", r"\?\?", r"A[;,o=]", r"w[=,]", r"[dvfCkIx]\n*$", r"[o=|+?A.Q~<dvfCk@]\n*$", r"(?:^|[;K])\n*s:(?!$)(?=.*;)", r"nK", r"sK",
)
_TYPED = {
    "(": _never("X", r"^\n*[o=.?:*>,]", r"[*:]\n*$", *_SCRIPT_ANY), "[": _never("X", r"^\n*[o=.?:*>;]", r"[:*]\n*$", *_SCRIPT_ANY),
    "{": _never("X", r"^\n*[o=.?>,]", r"(?<!D)[:]\n*$", *_SCRIPT_ANY), "": _never("X", r"^\n*[o=.?:*<>,{]", r"^\n*K\n*$", r"[:*,]\n*$", *_SCRIPT_ANY, r"(?:^|[;\nK])\n*kP\n*$"),
}
_PLAIN_ANY = (*_SCRIPT_ANY, r"f\*?[ic]?P\n*(?!K)", r"f\*?[ic]?<", r"(?:^|[;\nK])c?iP\n*:", r"[in]~", r"[dv][ic]:", r"C[ic](?:p[^K]*)?[<]")
_PLAIN = {
    "(": _never("X", r"^\n*[o=.?:*>,]", r"[*:]\n*$", r"^(?:[^?]*,)?\n*E?[ic]\??:", *_PLAIN_ANY), "[": _never("X", r"^\n*[o=.?:*>;]", r"[:*]\n*$", *_PLAIN_ANY),
    "{": _never("X", r"^\n*[o=.?>,]", r"(?<!D)[:]\n*$", *_PLAIN_ANY), "": _never("X", r"^\n*[o=.?:*<>,{]", r"^\n*K\n*$", r"[:*,]\n*$", *_PLAIN_ANY, r"(?:^|[;\nK])\n*kP\n*$"),
}
_JAVA_ANY = (
    "X", r"iii", r"[ns][ins]", r"i[ns]", r"(?<!@)(?<![.@]i[.])i[P][ns]", r"(?<![@.])iPi", r"(?<![@.])iP[mwkeIj]", r"[ns][wkejICGm]", r"i[wkejIG]", r"[o=|+?A.~][,;]", r"[o=?][o=]",
    r"\.\n*[,;.)n]", r"k(?!P)", r"ii[ns.]", r",[;o=?:.]", r"[o=|+?A.~@mkwCpIG]$", r"[PB]n", r"G(?!i)", r"w[=,]", r"[PKB]s", r"C(?!i)", r"@@", r"iK(?<!.iK)",
)
_JAVA = {
    "(": _never(r"^[o=.?:*>,]", r"[:*,]$", *_JAVA_ANY), "[": _never(r"^[o=.?:*>;,]", r"[:*,]$", *_JAVA_ANY),
    "{": _never(r"^[o=.?:>]", r"(?<!D)(?<!.):$", r"^[^;]*;.*[^;K]$", r"ii$", r"(?:^|[;K])m*i[<>i,.B]*i=[^;]*$", r"^[^,;]*kP$", *_JAVA_ANY), "": _never("X"),
}
_JAVA_FILE = re.compile(r"(?:(?:@i(?:\.i)*P?)*Gi(?:\.i)*;)?(?:Im?i(?:\.(?:i|\*))*;|;)*(?:(?:m|D|@i(?:\.i)*P?)*@?Ci[^;K=]*K|;)*")
_GO_ANY = (
    "X", r"iii", r"[ns][ins]", r"[i](?=n)", r"[PB][ns]", r"[o=|+~.][,;)=\n]*[,;)=]", r"[o=][o=]", r"\.\n*[,;.n]", r"[o=|+~.fvtk]\n*$", r"k(?=[;=.])", r",\n*[;o=:.]", r"[ns]K", r"==", r"w[=,]",
    r"f(?!i|P)", r"(?:^|\n)\n*iK",
)
_GO = {
    "(": _never(r"^\n*[=.:>,;]", r"[:]\n*$", r",.*[ins]\n+$", *_GO_ANY), "[": _never(r"^\n*[=.>;,]", *_GO_ANY),
    "{": _never(r"^\n*[o=.>,]", *_GO_ANY), "": _never("X"),
}
_GO_FILE = re.compile(
    r"[\n;]*Gi(?:[;\n]+(?:I(?:[i.]?s|P))*)?(?:[;\n]+I(?:[i.]?s|P))*(?:[;\n]+(?:f(?:P)?iB?P[^\n;K]*(?:SK[^\n;K]*)*(?:K)?|[vt](?:P|[ic][^\n;]*(?:\n[^\n;]*(?<=K))?)))*[;\n]*"
)
_RULES = {"typescript": _TYPED, "javascript": _PLAIN, "java": _JAVA, "go": _GO}
_AFTER_DOT = re.compile(rf"(?<=\.)(\n*)[{_WORDS}mGStM]|(?<=Q)[{_WORDS}]")
_AS_KEY = re.compile(rf"(?<=[{{,\n])[fCkewbdvIxjpcgrhyqzaW](?=\??:)|(?<=[\n{{;}}c])[fCewbdvIxDjpcaW](?=\()(?<!f)|(?<=c)[hkgr](?=\()")
#: What the statements of a block or file never do, line ends left out: an else without an if, a try without what it
#: tries for, a catch or finally after no block, a const without value, a function without a name, a number assigned to.
_STATEMENTS = (r"^[^g]*e", r"y(?!P?K[hz])", r"(?:^|[^K])[hz]", r"h(?!P?K)", r"n=", r",,", r"[o=|+,][gkyqWjea]", r"(?:^|[;K])PK", r"W[gkyqWjeazh]", r"(?:^|[;K])a[a:;]|aa")
_SCRIPT_STATEMENTS = _never(*_STATEMENTS, r"(?<!c)d[ic](?=[;,]|$)", r"(?:^|[;K])(?:xc?)?f\*?P", r"(?:^|[;K])x?CK", r":,", r"^:", r"Ic?K(?!cs)", r"x[sinPoWwgkj;,]", r"DD", r"Wr")
_JAVA_STATEMENTS = _never(*_STATEMENTS, r"T[=;,o]", r"(?<![@.])ii<", r"Wii", r"\.P", r"(?<![;K:PeqA\])])W(?!$)(?<!^W)")
#: What brackets other than braces never hold beside that: statement words, an empty place between commas.
_INSIDE = re.compile(r",\n*,|[gkyqWjezha]|x|;\n*\)")
_GO_STATEMENTS = _never(r"\n\n*e", r"(?:^|[^K])e", r"n=", r"(?:^|[\n;:])\n*ii(?=\n|$)")
_DO_LOOP = re.compile(r"q\n*K\n*kP")
_GIVEN = re.compile(r"Y(?=[insw~+(-])")
_NO_BINDING = re.compile(r"h(\n*)K")
_BREAKS = re.compile(r"\n{2,}")
_BRACKET = re.compile(r"([()\[\]{}])")
_CLOSING = {"(": ")", "[": "]", "{": "}"}
_JSON_GROUP = {"(": re.compile("(?!)"), "[": re.compile("(?:[sn](?:,[sn])*)?"), "{": re.compile("(?:s:[sn](?:,s:[sn])*)?")}


class Checker:
    """Checks whole files of one language; remembers the groups it has seen, which are few."""

    def __init__(self, language: str) -> None:
        self.language = language
        self.kinds = lexer(language).fine
        self.rules = _RULES.get(language)
        self.seen: dict[str, str] = {}

    def _flat(self, inner: str, rules: re.Pattern, block: bool, before: str) -> bool:
        """Whether a group, or a file as `before` is empty, is what its language allows."""
        if block:
            if self.language == "go":
                if _GO_STATEMENTS.search(inner) and not (before[-1:] == "S" and not re.search(r"\ne|n=", inner)):
                    return False
            else:
                told = inner.replace("\n", "")
                if (_JAVA_STATEMENTS if self.language == "java" else _SCRIPT_STATEMENTS).search(told) or "a" in told and before != "rP":
                    return False
                if self.language == "java" and before[-1:] in ("P", "e", "y", "q", "z") and before != "" and inner[-1:] not in ("", ";", "K", ":"):
                    return False
        elif rules is not self.rules["["] and self.language != "go" and rules is self.rules["("]:
            if _INSIDE.search(inner) or ";" in inner and (before not in ("k", "y", "w") or before != "y" and inner.count(";") != 2):
                return False
            if self.language == "java" and (before == "h" and inner in ("i", "") or re.search(r"(?<![@.])ii<|\.P", inner)):
                return False
        coarse = _NO_BINDING.sub(r"hP\1K", _DO_LOOP.sub("iP", inner)).translate(COARSE)
        return not rules.search(coarse)

    def _group(self, before: str, opened: str, inner: str) -> str:
        key = f"{before}{opened}{inner}"
        known = self.seen.get(key)
        if known is None:
            good = not self.rules or self._flat(inner, self.rules[opened], opened == "{", before)
            known = self.seen[key] = _SYMBOL[opened] if good else "X"
        return known

    def _reduced(self, kinds: str) -> tuple[str | None, str]:
        """(reason, the file with one symbol for each outermost group)."""
        parts = _BRACKET.split(kinds)
        now, opened = [parts[0]], []
        for bracket, text in zip(parts[1::2], parts[2::2], strict=True):
            if bracket in _CLOSING:
                opened.append((bracket, now))
                now = [text]
                continue
            if not opened:
                return "brackets", ""
            last, outer = opened.pop()
            if _CLOSING[last] != bracket:
                return "brackets", ""
            before = "".join(outer[-3:]).rstrip("\n")[-2 if last == "{" else -1 :] if last != "[" and self.rules else ""
            symbol = self._group(before, last, "".join(now))
            if symbol == "X":
                return "tokens", ""
            outer += (symbol, text)
            now = outer
        return ("brackets", "") if opened else (None, "".join(now))

    def reason(self, text: str) -> str | None:
        """Why the text is not valid, or None."""
        if self.language == "json":
            return self._json(text)
        kinds = self.kinds(text)
        if "X" in kinds:
            return "literal"
        if not kinds.strip("\n"):
            return "empty" if self.language == "go" else None
        if self.rules:
            kinds = _BREAKS.sub("\n", _AFTER_DOT.sub("i", kinds))
            if self.language == "java":
                kinds = _GIVEN.sub("w", kinds).replace("Y", "i")
            elif self.language != "go":
                kinds = _AS_KEY.sub("i", kinds)
        if len(self.seen) > 200_000:
            self.seen.clear()
        why, kinds = self._reduced(kinds)
        if why:
            return why
        if self.language == "python":
            return self._python(text)
        kinds = _BREAKS.sub("\n", kinds)
        if self.language == "java":
            return None if _JAVA_FILE.fullmatch(kinds.translate(COARSE)) else "end"
        if self.language == "go":
            return None if _GO_FILE.fullmatch(kinds) else "end"
        return None if self._flat(kinds, self.rules[""], True, "") else "tokens"

    @staticmethod
    def _python(text: str) -> str | None:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (RecursionError, MemoryError):
            return None
        except SyntaxError as why:
            return None if str(why.msg).startswith("too many nested") else "parser"
        except ValueError:
            return "parser"
        return None

    def _json(self, text: str) -> str | None:
        """The pushdown runs once over the brackets, so that deep nesting costs no more; json.loads decides the rest."""
        kinds = self.kinds(text)
        if not text.strip():
            return "empty"
        if "X" in kinds:
            return "literal"
        groups: list[list[str]] = [[]]
        opened: list[str] = []
        for part in _BRACKET.split(kinds):
            if part in _CLOSING:
                opened.append(part)
                groups.append([])
            elif part and part in ")]}":
                if not opened or _CLOSING[opened[-1]] != part:
                    return "brackets"
                if not _JSON_GROUP[opened.pop()].fullmatch("".join(groups.pop())):
                    return "tokens"
                groups[-1].append("n")
            else:
                groups[-1].append(part)
        if opened:
            return "brackets"
        if not re.fullmatch("[sn]", "".join(groups[0])):
            return "tokens"

        def no(_: str) -> None:
            raise ValueError

        try:
            json.loads(text, parse_constant=no)
        except ValueError:
            return "parser"
        except RecursionError:  # too deep for the parser, which says nothing about the text
            return None
        return None


_checkers: dict[str, Checker] = {}


def reason_of(language: str, text: str) -> str | None:
    if language not in _checkers:
        _checkers[language] = Checker(language)
    return _checkers[language].reason(text)


def language_of(entity_id: Column, path: Column) -> Column:
    """Language of a file by its id, and by its extension where the id doesn't tell one that is checked."""
    said = F.lower(F.split_part(entity_id, F.lit(":"), F.lit(2)))
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    by_path = (
        F.when(ending.isin("py", "pyi"), "python").when(ending.isin("ts", "tsx", "mts"), "typescript").when(ending.isin("js", "mjs", "cjs", "jsx"), "javascript")
        .when(ending == "java", "java").when(ending == "go", "go").when(ending == "json", "json").otherwise(said)
    )
    return F.when(said.isin(*LANGUAGES), said).otherwise(by_path)


def invalid_reason(language: Column, text: Column) -> Column:
    """Why a file is not valid in its language (one of REASONS), or null.

    Null texts and languages that are not checked give null. Empty texts are valid except in go and json.
    """

    @F.arrow_udf("string")
    def why(languages: pa.Array, texts: pa.Array) -> pa.Array:
        pairs = zip(languages.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([None if t is None or g not in LANGUAGES else reason_of(g, t) for g, t in pairs], pa.string())

    return why(language, text)


def checked_files(entities: DataFrame) -> DataFrame:
    """`entity_id, version, repository_id, language, reason` for each file version with a text in a checked language.

    A version delivered more than once counts once, as delivered last. Ids of any table may be null and form a
    group of their own. An empty table gives no rows; further columns are ignored.
    """
    files = entities.where("entity_type = 'File' and source_code is not null").select(
        "entity_id", "version", "repository_id", "ingested_at", language_of(F.col("entity_id"), F.col("file_path")).alias("language"), "source_code"
    ).where(F.col("language").isin(*LANGUAGES))
    flagged = files.withColumn("reason", invalid_reason(F.col("language"), F.col("source_code"))).drop("source_code")
    return flagged.groupBy("entity_id", "version").agg(F.max_by(F.struct("repository_id", "language", "reason"), "ingested_at").alias("r")).select(
        "entity_id", "version", "r.repository_id", "r.language", "r.reason"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return checked_files(table(spark, d, "code_entities")).where("reason is not null").select("entity_id", "version")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, invalid files and their rate per repository and language."""
    return checked_files(table(spark, d, "code_entities")).groupBy("repository_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("reason").alias("n_invalid"), F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("invalid_rate")
    )


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
