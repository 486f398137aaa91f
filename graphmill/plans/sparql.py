"""A SPARQL subset: text to algebra to DataFrame.

Each triple pattern is a filtered projection of the store, patterns are joined on their shared variables, and
OPTIONAL, UNION and FILTER become left joins, unions and conditions; the order of joins is left to the optimizer.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<[^>\s]*>|\"(?:[^\"\\]|\\.)*\"|\?\w+|[A-Za-z_][\w\-]*:[\w\-./#]*|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|<=|>=|!=|&&|\|\||[{}().;,*=<>!/^|]")
_WHOLE = re.compile(rf"\s*(?:(?:{_TOKEN.pattern})\s*)*")
_AGGREGATES: dict[str, Callable[[Column], Column]] = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "SAMPLE": F.min}


class Query:
    """A parsed query. `run` takes the store, or a function from a predicate (or None) to the store's part with it."""

    def __init__(self, text: str) -> None:
        plain = re.sub(r"(?m)^\s*#.*$", "", text)
        if not _WHOLE.fullmatch(plain):
            raise ValueError("the query holds characters that belong to no word of the language")
        self._begin(_TOKEN.findall(plain), text)

    def _begin(self, words: list[str], text: str) -> None:
        self.words, self.at, self.fresh = words, 0, 0
        if not self.words:
            raise ValueError("an empty query")
        if text.count("{") != text.count("}"):
            raise ValueError("unbalanced braces")
        self.prefixes: dict[str, str] = {}
        while self._is("PREFIX"):
            self._next()
            name, full = self._next(), self._next()
            self.prefixes[name] = full.strip("<>")
        self.form = self._next().upper()
        if self.form == "DESCRIBE":
            self.described = self._term()
            if self.described[0] == "var" or self.at < len(self.words):
                raise ValueError("DESCRIBE takes one resource")
            return
        self._parse()

    def _parse(self) -> None:
        self.distinct, self.columns, self.template = False, [], []
        if self.form == "SELECT":
            if self._is("DISTINCT"):
                self.distinct = bool(self._next())
            while not self._is("WHERE") and not self._is("{"):
                self.columns.append(self._column())
        elif self.form == "CONSTRUCT":
            self.template = self._template()
        elif self.form != "ASK":
            raise ValueError(f"no query form: {self.form}")
        if self._is("WHERE"):
            self._next()
        self.where = self._group()
        self.group, self.having, self.order, self.limit, self.offset = [], None, [], None, 0
        while self.at < len(self.words) and not self._is("}"):
            word = self._next().upper()
            if word == "GROUP":
                self._next()
                while self._peek().startswith("?"):
                    self.group.append(self._next()[1:])
            elif word == "HAVING":
                self.having = self._condition()
            elif word == "ORDER":
                self._next()
                while self.at < len(self.words) and (self._peek().startswith("?") or self._peek().upper() in ("ASC", "DESC")):
                    down = self._peek().upper() == "DESC"
                    if self._peek().upper() in ("ASC", "DESC"):
                        self._next(), self._next()
                        self.order.append((self._next()[1:], down))
                        self._next()
                    else:
                        self.order.append((self._next()[1:], False))
            elif word == "LIMIT":
                self.limit = int(self._next())
            elif word == "OFFSET":
                self.offset = int(self._next())
            else:
                raise ValueError(f"unexpected {word}")

    def _peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def _next(self) -> str:
        if self.at >= len(self.words):
            raise ValueError("the query ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def _is(self, word: str) -> bool:
        return self._peek().upper() == word

    def _column(self) -> tuple[str, str, str | None, bool]:
        """(name, aggregate, variable, distinct)"""
        word = self._next()
        if word == "*" or word.startswith("?"):
            return word.lstrip("?"), "", word[1:], False
        kind, inner, unique = self._next().upper(), None, False
        self._next()
        if self._is("DISTINCT"):
            unique = bool(self._next())
        inner = self._next()
        between = " "
        while (word := self._next()) != ")":
            if word.upper() == "SEPARATOR":
                self._next()
                between = self._term()[1]
        self._next()
        name = self._next()[1:]
        self._next()
        return name, kind + (f" {between}" if kind == "GROUP_CONCAT" else ""), None if inner == "*" else inner[1:], unique

    def _path(self) -> list[list[tuple[bool, tuple[str, str]]]]:
        """Alternatives of sequences of steps (inverse, term)."""
        ways: list[list[tuple[bool, tuple[str, str]]]] = [[]]
        while True:
            inverse = self._is("^") and bool(self._next())
            ways[-1].append((inverse, self._term()))
            if self._is("/"):
                self._next()
            elif self._is("|"):
                self._next()
                ways.append([])
            else:
                return ways

    def _add(self, group: dict, subject: tuple, ways: list, obj: tuple) -> None:
        """The patterns of a path; steps meet in variables of their own, alternatives become a union."""
        chains = []
        for steps in ways:
            at, chain = subject, []
            for n, (inverse, term) in enumerate(steps):
                self.fresh += n < len(steps) - 1
                to = obj if n == len(steps) - 1 else ("var", f"_{self.fresh}")
                chain.append((to, term, at) if inverse else (at, term, to))
                at = to
            chains.append(chain)
        if len(chains) == 1:
            group["patterns"] += chains[0]
        else:
            group["union"].append([{"patterns": c, "optional": [], "union": [], "filter": []} for c in chains])

    def _term(self) -> tuple[str, str]:
        word = self._next()
        if word.startswith("?"):
            return "var", word[1:]
        if word.startswith('"'):
            return "literal", word[1:-1].replace('\\"', '"')
        if word.startswith("<"):
            return "term", word[1:-1]
        prefix, colon, rest = word.partition(":")
        if colon and prefix + ":" in self.prefixes:
            return "term", self.prefixes[prefix + ":"] + rest
        return "term", word

    def _template(self) -> list[tuple]:
        out = []
        self._next()
        while not self._is("}"):
            out.append((self._term(), self._term(), self._term()))
            if self._is("."):
                self._next()
        self._next()
        return out

    def _group(self) -> dict:
        group: dict = {"patterns": [], "optional": [], "union": [], "filter": []}
        if self._next() != "{":
            raise ValueError("a group begins with a brace")
        while not self._is("}"):
            if self._is("OPTIONAL"):
                self._next()
                group["optional"].append(self._group())
            elif self._is("FILTER"):
                self._next()
                group["filter"].append(self._condition())
            elif self._is("{"):
                if self.words[self.at + 1].upper() == "SELECT":
                    self._next()
                    group.setdefault("inner", []).append(self._inner())
                    continue
                branches = [self._group()]
                while self._is("UNION"):
                    self._next()
                    branches.append(self._group())
                group["union"].append(branches)
            else:
                subject = self._term()
                while True:
                    ways = self._path()
                    self._add(group, subject, ways, self._term())
                    while self._is(","):
                        self._next()
                        self._add(group, subject, ways, self._term())
                    if not self._is(";"):
                        break
                    self._next()
            if self._is("."):
                self._next()
        self._next()
        return group

    def _inner(self) -> Query:
        """A subquery, read from the same words."""
        inner = Query.__new__(Query)
        inner.words, inner.at, inner.fresh, inner.prefixes = self.words, self.at, self.fresh + 1000, self.prefixes
        inner.form = inner._next().upper()
        inner._parse()
        self.at = inner.at
        self._next()
        return inner

    def _condition(self) -> Column:
        left = self._conjunction()
        while self._peek() == "||":
            self._next()
            left = left | self._conjunction()
        return left

    def _conjunction(self) -> Column:
        left = self._test()
        while self._peek() == "&&":
            self._next()
            left = left & self._test()
        return left

    def _test(self) -> Column:
        if self._is("!"):
            self._next()
            return ~self._test()
        if self._is("("):
            self._next()
            inner = self._condition()
            self._next()
            return inner
        left = self._operand()
        if self._is("IN"):
            self._next(), self._next()
            among = []
            while not self._is(")"):
                among.append(self._operand())
                if self._is(","):
                    self._next()
            self._next()
            return left.isin(*among)
        if self._peek() not in ("=", "!=", "<", "<=", ">", ">="):
            return left
        sign, right = self._next(), self._operand()
        if re.fullmatch(r"-?\d+(?:\.\d+)?", self.words[self.at - 1]):
            left = left.try_cast("double")
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]

    def _operand(self) -> Column:
        word = self._peek()
        if word.startswith("?"):
            return F.col(self._next()[1:])
        if re.fullmatch(r"-?\d+(?:\.\d+)?", word):
            return F.lit(float(self._next()))
        if word.startswith(('"', "<")) or ":" in word:
            return F.lit(self._term()[1])
        name = self._next().upper()
        self._next()
        args = []
        while not self._is(")"):
            args.append(self._operand())
            if self._is(","):
                self._next()
        self._next()
        known: dict[str, Callable[..., Column]] = {
            "CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith, "REGEX": F.rlike, "BOUND": F.isnotnull, "STRLEN": F.length, "LCASE": F.lower, "UCASE": F.upper, "STR": lambda c: c,
        }
        if name not in known:
            raise ValueError(f"no function {name}")
        return known[name](*args)

    def run(self, store: DataFrame | Callable[[str | None], DataFrame]) -> DataFrame:
        part = store if callable(store) and not isinstance(store, DataFrame) else lambda _: store
        if self.form == "DESCRIBE":
            return part(None).where((F.col("subject") == self.described[1]) | (F.col("object") == self.described[1])).select("subject", "predicate", "object")
        found = self._rows(self.where, part)
        if self.form == "ASK":
            return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if self.form == "CONSTRUCT":
            cell = lambda t: F.col(t[1]) if t[0] == "var" else F.lit(t[1])
            made = [found.select(cell(s).alias("subject"), cell(p).alias("predicate"), cell(o).alias("object")) for s, p, o in self.template]
            return reduce(DataFrame.unionByName, made).where("subject is not null and predicate is not null and object is not null").distinct()
        sums = [c for c in self.columns if c[1]]
        if sums or self.group:
            found = found.groupBy(*self.group).agg(*(self._aggregate(c).alias(c[0]) for c in sums)) if sums else found.select(*self.group).distinct()
            if self.having is not None:
                found = found.where(self.having)
        if not any(c[0] == "*" for c in self.columns):
            found = found.select(*(c[0] for c in self.columns))
        if self.distinct:
            found = found.distinct()
        if self.order:
            found = found.orderBy(*(F.col(v).desc_nulls_last() if down else F.col(v).asc_nulls_first() for v, down in self.order))
        if self.offset:
            found = found.offset(self.offset)
        return found if self.limit is None else found.limit(self.limit)

    @staticmethod
    def _aggregate(column: tuple[str, str, str | None, bool]) -> Column:
        _, kind, variable, unique = column
        value = F.lit(1) if variable is None else F.col(variable)
        if kind.startswith("GROUP_CONCAT"):
            return F.array_join(F.array_sort(F.collect_set(value) if unique else F.collect_list(value)), kind[13:])
        number = value.try_cast("double")
        if kind in ("SUM", "AVG"):
            if unique:
                return F.sum_distinct(number) if kind == "SUM" else F.sum_distinct(number) / F.count_distinct(number)
            return _AGGREGATES[kind](number)
        if kind in ("MIN", "MAX"):  # numbers by their value, before any other text
            best = F.min_by if kind == "MIN" else F.max_by
            return best(value, F.struct(number.isNull() if kind == "MIN" else number.isNotNull(), number, value))
        if kind == "COUNT" and unique:
            return F.count_distinct(value)
        return _AGGREGATES[kind](value)

    def _rows(self, group: dict, part: Callable[[str | None], DataFrame]) -> DataFrame:
        frames = [self._pattern(p, part) for p in group["patterns"]]
        frames += [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self._rows(b, part) for b in branches)) for branches in group["union"]]
        frames += [q.run(part) for q in group.get("inner", [])]
        joined = frames[0]
        left = frames[1:]
        while left:
            nearest = next((f for f in left if set(f.columns) & set(joined.columns)), left[0])
            left.remove(nearest)
            joined = self._join(joined, nearest, "inner")
        for inner in group["optional"]:
            joined = self._join(joined, self._rows(inner, part), "left")
        for condition in group["filter"]:
            joined = joined.where(condition)
        return joined

    @staticmethod
    def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("patterns without a common variable would be a product of all their rows")
        return a.join(b, shared, how)

    @staticmethod
    def _pattern(pattern: tuple, part: Callable[[str | None], DataFrame]) -> DataFrame:
        predicate = pattern[1]
        rows = part(predicate[1] if predicate[0] != "var" else None)
        names: dict[str, str] = {}
        for column, (kind, value) in zip(("subject", "predicate", "object"), pattern, strict=True):
            if kind != "var":
                rows = rows.where(F.col(column) == value)
                if kind == "literal" and column == "object" and "object_type" in rows.columns:
                    rows = rows.where("object_type = 'literal'")
            elif value in names:
                rows = rows.where(F.col(column) == F.col(names[value]))
            else:
                names[value] = column
        return rows.select(*(F.col(c).alias(v) for v, c in names.items()))


def sparql(store: DataFrame | Callable[[str | None], DataFrame], text: str) -> DataFrame:
    """Rows of a SELECT, one row of an ASK, triples of a CONSTRUCT."""
    return Query(text).run(store)


def within(found: DataFrame, seconds: float = 30.0) -> list:
    """The rows of a query, or TimeoutError if they are not there in time; its jobs are cancelled then."""
    ctx, group = found.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        ctx.cancelJobGroup(group)

    clock = threading.Timer(seconds, stop)
    ctx.setJobGroup(group, "query with a time limit", True)
    clock.start()
    try:
        return found.collect()
    except Exception as why:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} seconds") from why
        raise
    finally:
        clock.cancel()
        ctx.setLocalProperty("spark.jobGroup.id", None)
