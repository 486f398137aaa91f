"""A small query language over records: SELECT, FIND, COUNT, GET and AGGREGATE, planned as DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|<=|>=|!=|<>|[(),=<>*]|\$\w+|[^\s(),=<>!*'\"]+")
_WHOLE = re.compile(rf"\s*(?:(?:{_TOKEN.pattern})\s*)*")


class _Reader:
    def __init__(self, text: str, args: dict[str, object]) -> None:
        if not _WHOLE.fullmatch(text):
            raise ValueError("the query holds characters that belong to no word of the language")
        self.words, self.at, self.args = _TOKEN.findall(text), 0, args

    def peek(self) -> str:
        return self.words[self.at] if self.at < len(self.words) else ""

    def next(self) -> str:
        if self.at >= len(self.words):
            raise ValueError("the query ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def took(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False

    def value(self) -> object:
        """A literal: quoted text stays text; unquoted numbers, booleans and null are typed; $name is a parameter."""
        word = self.next()
        if word[0] in "'\"":
            return word[1:-1].replace("''", "'")
        if word[0] == "$":
            return self.args[word[1:]]
        if word.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word.lower()]
        return int(word) if re.fullmatch(r"-?\d+", word) else float(word) if re.fullmatch(r"-?\d+\.\d+", word) else word

    def count(self) -> int:
        n = self.value()
        if not isinstance(n, int) or n < 0:
            raise ValueError(f"not a count: {n}")
        return n

    def condition(self) -> Column:
        left = self.conjunction()
        while self.took("OR"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.test()
        while self.took("AND"):
            left = left & self.test()
        return left

    def test(self) -> Column:
        if self.took("NOT"):
            return ~self.test()
        if self.took("("):
            inner = self.condition()
            self.next()
            return inner
        field, sign = F.col(self.next()), self.next().lower()
        if sign == "in":
            self.next()
            values = [self.value()]
            while self.took(","):
                values.append(self.value())
            self.next()
            return field.isin(*values)
        value = self.value()
        if value is None:
            return field.isNull() if sign in ("=", "eq") else field.isNotNull()
        known = {
            "=": lambda: field == value, "eq": lambda: field == value, "!=": lambda: field != value, "<>": lambda: field != value, "ne": lambda: field != value, "<": lambda: field < value, "lt": lambda: field < value, "<=": lambda: field <= value,
            "le": lambda: field <= value, ">": lambda: field > value, "gt": lambda: field > value, ">=": lambda: field >= value, "ge": lambda: field >= value, "contains": lambda: F.contains(F.lower(field.cast("string")), F.lit(str(value).lower())),
        }
        if sign not in known:
            raise ValueError(f"no operator {sign}")
        return known[sign]()


def run(records: DataFrame, text: str, args: dict[str, object] | None = None, key: str = "id") -> DataFrame:
    """Plans a query over one frame. Unknown forms raise ValueError; LIMIT 0 gives no rows."""
    q = _Reader(text, args or {})
    form = q.next().upper()
    if form == "GET":
        return records.where(F.col(key) == q.value())
    if form == "FIND":
        words = " ".join(q.words[q.at :]).strip("'\"").lower()
        return records.where(F.contains(F.lower(F.concat_ws("", *(F.col(c).cast("string") for c in records.columns))), F.lit(words)))
    if form == "COUNT":
        rows = records.where(q.condition()) if q.took("WHERE") else records
        return rows.agg(F.count(F.lit(1)).alias("n"))
    if form == "AGGREGATE":
        field, kind = F.col(q.next()), q.next().lower()
        number = field.try_cast("double")
        return records.agg({"count": F.count(field), "sum": F.sum(number), "avg": F.avg(number), "min": F.min(number), "max": F.max(number)}[kind].alias("value"))
    if form != "SELECT":
        raise ValueError(f"no query form: {form}")
    columns = [q.next()]
    while q.took(","):
        columns.append(q.next())
    rows = records
    if q.took("FROM"):
        q.next()
    if q.took("WHERE"):
        rows = rows.where(q.condition())
    if q.took("ORDER"):
        q.next()
        order = []
        while True:
            field = F.col(q.next())
            order.append(field.desc_nulls_last() if q.took("DESC") else field.asc_nulls_first())
            q.took("ASC")
            if not q.took(","):
                break
        rows = rows.orderBy(*order)
    limit = q.count() if q.took("LIMIT") else None
    if q.took("OFFSET"):
        rows = rows.offset(q.count())
    if limit is None and q.took("LIMIT"):
        limit = q.count()
    rows = rows if limit is None else rows.limit(limit)
    return rows if columns == ["*"] else rows.select(*(c for c in columns if c in records.columns))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
