"""Label matchers as Spark predicates that reach the Parquet scan where it can use them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import QueryError, label
from .re2 import Pattern

_PLAIN = re.compile(r"[^\\.+*?()\[\]{}^$|]*")
_SET = re.compile(r"[^\\.+*?()\[\]{}^$]*")


_compiled = lru_cache(1024)(Pattern)


@dataclass(frozen=True)
class Matcher:
    """op is one of = != =~ !~; an absent label is the empty string."""

    name: str
    op: str
    value: str

    def __post_init__(self) -> None:
        if self.op not in ("=", "!=", "=~", "!~"):
            raise QueryError(f"unknown matcher type {self.op!r}")
        if self.op in ("=~", "!~"):
            self._pattern()

    def _pattern(self) -> Pattern:
        return _compiled(self.value)

    def matches(self, value: str) -> bool:
        hit = value == self.value if self.op in ("=", "!=") else self._pattern().full_match(value)
        return hit != self.op.startswith("!")

    def literals(self) -> list[str] | None:
        """The strings of a pattern that is one literal or a choice of literals."""
        return self.value.split("|") if _SET.fullmatch(self.value) else None

    def column(self, labels: list[str]) -> Column:
        """The predicate; a label that no column has is folded to a constant."""
        if self.name not in labels:
            return F.lit(self.matches(""))
        c = label(self.name)
        if self.op == "=":
            return (c.isNull() | (c == "")) if self.value == "" else c == self.value
        if self.op == "!=":
            return (c.isNotNull() & (c != "")) if self.value == "" else c.isNull() | (c != self.value)
        if (some := self.literals()) is not None:
            full = [x for x in dict.fromkeys(some) if x]
            empty = "" in some
            if self.op == "=~":
                hit = c.isin(full) if full else F.lit(False)
                return (hit | c.isNull() | (c == "")) if empty else hit
            miss = ~c.isin(full) if full else F.lit(True)
            return (c.isNotNull() & (c != "") & miss) if empty else c.isNull() | miss
        hit = c.rlike(self._pattern().anchored)
        head = _PLAIN.match(self.value).group()
        if head and self.value[len(head) :][:1] in ("*", "?", "{", "+"):
            head = head[:-1]
        if head and "|" not in self.value:
            hit = c.startswith(head) & hit  # the prefix is what a scan can push
        if self.op == "=~":
            return (hit | c.isNull()) if self.matches("") else hit
        return (~hit | c.isNull()) if self.matches("") else ~hit & c.isNotNull()


def split_constant(matchers: list[Matcher], constants: dict[str, str]) -> list[Matcher] | None:
    """Matchers left after those on constant labels; None if one of these fails."""
    if any(not m.matches(constants[m.name]) for m in matchers if m.name in constants):
        return None
    return [m for m in matchers if m.name not in constants]


def predicate(matchers: list[Matcher], labels: list[str]) -> Column:
    return reduce(Column.__and__, [m.column(labels) for m in matchers], F.lit(True))


def selective(matchers: list[Matcher]) -> bool:
    """Does any matcher refuse the empty string?"""
    return any(not m.matches("") for m in matchers)
