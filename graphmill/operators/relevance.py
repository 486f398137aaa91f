"""Semantic relevance of triples to a question: terms, composite similarity, boosts, threshold and explanation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import DIMENSIONS, cosine, jaccard, word_set

#: Categories of terms with their weights, and terms that mean related things.
WEIGHTS = {"technical": 1.5, "action": 1.2, "relationship": 1.2, "domain": 1.3}
CATEGORIES = {
    "technical": ("function", "method", "class", "interface", "type", "module", "component"),
    "action": ("create", "update", "delete", "get", "set", "call", "invoke", "execute"),
    "relationship": ("depends", "extends", "implements", "uses", "calls", "returns"),
    "domain": ("user", "auth", "login", "authentication", "session", "token", "security"),
}
RELATED = {
    "user": ("auth", "login", "session", "account", "profile"),
    "authentication": ("login", "auth", "verify", "credential", "token"),
    "login": ("user", "auth", "session", "signin", "access"),
    "method": ("function", "procedure", "operation", "action"),
    "function": ("method", "procedure", "operation", "call"),
    "class": ("type", "object", "instance", "entity"),
    "module": ("component", "package", "library", "service"),
}


@dataclass(frozen=True)
class Question:
    terms: tuple[tuple[str, float], ...]

    @property
    def words(self) -> list[str]:
        return [t for t, _ in self.terms]


def read_question(text: str) -> Question:
    """Terms of a question with their weights: of the first category that has a term in the word or the word in a term, a tenth more for long words."""
    terms = []
    for word in dict.fromkeys(re.findall(r"[a-z0-9_]+", text.lower())):
        if len(word) > 2:
            weight = next((WEIGHTS[k] for k, words in CATEGORIES.items() if any(w in word or word in w for w in words)), 1.0)
            terms.append((word, round(weight * (1.1 if len(word) > 6 else 1.0), 4)))
    return Question(tuple(terms))


def _hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return abs(value)


def question_vector(question: Question) -> list[float]:
    """Unit vector of a question, computed once on the driver."""
    raw = [sum(math.sin((_hash(t) + d) * 0.1) * w for t, w in question.terms) for d in range(DIMENSIONS)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw] if norm else raw


def text_of(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def related_score(text: Column, question: Question, same: Column | None = None) -> Column:
    """Half the Jaccard similarity and 0.3 times the weight for each related term that the text holds, at most 1; `same` is that similarity where it is known."""
    words = F.array(*(F.lit(w) for w in question.words)) if question.words else F.array().cast("array<string>")
    parts = [F.when(F.contains(text, F.lit(r)), 0.3 * w).otherwise(0.0) for t, w in question.terms for r in RELATED.get(t, ())]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts, (jaccard(word_set(text), words) if same is None else same) * 0.5))


def structural_score(question: Question) -> Column:
    """0.4 for a hit in the subject, 0.4 in the predicate, 0.2 in the object, and 0.2 more for subject and predicate together."""
    hit = lambda c: reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(w)) for w in question.words), F.lit(False))
    s, p, o = hit("subject"), hit("predicate"), hit("object")
    return F.least(F.lit(1.0), s.cast("int") * 0.4 + p.cast("int") * 0.4 + o.cast("int") * 0.2 + (s & p).cast("int") * 0.2)


def boost(text: Column, age_days: Column | None = None) -> Column:
    """Additions for domains, relationship predicates and recent facts."""
    out = F.when(text.rlike("auth|login|token"), 0.2).otherwise(0.0) + F.when(text.rlike("service|api|database"), 0.15).otherwise(0.0)
    out = out + F.when(F.lower("predicate").rlike("depends|uses|calls"), 0.1).when(F.lower("predicate").startswith("has"), 0.05).otherwise(0.0)
    return out if age_days is None else out + F.when(age_days < 7, 0.1).when(age_days < 30, 0.05).otherwise(0.0)


def spaced(text: Column) -> Column:
    """A text whose runs of `a-z` and `0-9` are its words in lower case, parted at capitals too; a text that has none stays as it is.

    `\\P{Alnum}` is `[^A-Za-z0-9]`, which the JVM's regex takes several times as long for.
    """
    cut = F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), r"\P{Alnum}+", " "))
    return F.when(F.lower(text) == text, text).otherwise(cut)


def may_match(question: Question) -> Column:
    """Whether a triple can have a score without a vector: a part holds a term of the question or a related one, or is null."""
    parts = ("subject", "predicate", "object")
    terms = dict.fromkeys([*question.words, *(r for w in question.words for r in RELATED.get(w, ()))])
    held = [F.lower(F.col(c)).rlike("|".join(map(re.escape, terms))) for c in parts] if terms else []
    return reduce(lambda a, b: a | b, [*held, *(F.col(c).isNull() for c in parts)])


def semantic_search(triples: DataFrame, question: Question, limit: int, threshold: float = 0.1, vector: str | None = None) -> DataFrame:
    """The best triples for a question: `subject, predicate, object, score, reason`.

    The score is 0.3 cosine (where the triples have a vector), 0.3 Jaccard, 0.25 related terms and 0.15 structure, plus
    the boosts, at most 1. Ties go by the terms of the triple, so that a repeated search gives the same rows.

    All triples are read; those that can only score 0 are dropped by one look at each part. Of the others each
    intermediate value is a column of its own, which is computed once. The threshold is on the leading term of the order, so
    that it may follow the limit: before it the engine would compute the score a second time to filter by it.
    """
    asked = list(dict.fromkeys(question.words))
    found = triples.where(may_match(question)) if vector is None and threshold > 0 else triples
    near = cosine(F.col(vector), F.array(*(F.lit(x) for x in question_vector(question)))) if vector else F.lit(0.0)
    words = F.array_distinct(F.regexp_extract_all("plain", F.lit("[a-z0-9]+"), 0))
    shared = reduce(lambda a, b: a + b, (F.array_contains("words", w).cast("int") for w in asked), F.lit(0))
    union = F.size("words") + len(asked) - F.col("shared")
    base = F.col("near") * 0.3 + F.col("same") * 0.3 + related_score(F.col("plain"), question, F.col("same")) * 0.25 + structural_score(question) * 0.15
    score = F.round(F.when(F.col("base") > 0, F.least(F.lit(1.0), F.col("base") + boost(F.col("text")))).otherwise(0.0), 6)
    plain = F.concat_ws(" ", *(spaced(F.col(c)) for c in ("subject", "predicate", "object")))
    parts = found.select("subject", "predicate", "object", near.alias("near"), text_of("subject", "predicate", "object").alias("text"), plain.alias("plain"))
    counted = parts.withColumn("words", words).withColumn("shared", shared)
    scored = counted.withColumn("same", F.when(union == 0, 0.0).otherwise(F.col("shared") / union)).withColumn("base", base).select("subject", "predicate", "object", score.alias("score"))
    best = scored.orderBy(F.desc("score"), "subject", "predicate", "object").limit(limit).where(F.col("score") >= threshold)
    hits = [F.when(F.contains(text_of("subject", "predicate", "object"), F.lit(w)), F.lit(w)) for w in question.words]
    return best.withColumn("reason", F.concat(F.lit("matches "), F.concat_ws(", ", *hits)))


def sentence(predicate: str = "predicate") -> Column:
    """A triple as a plain sentence: hasType reads 'is a', other predicates are split at their capitals."""
    name = F.regexp_replace(F.substring_index(F.substring_index(predicate, ":", -1), "#", -1), "([a-z])([A-Z])", "$1 $2")
    verb = F.when(F.col(predicate).endswith("hasType"), "is a").otherwise(F.lower(name))
    last = lambda c: F.substring_index(F.substring_index(F.substring_index(c, "/", -1), "#", -1), ":", -1)
    return F.concat_ws(" ", last("subject"), verb, last("object"))
