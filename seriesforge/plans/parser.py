"""Query language: tokens, syntax tree, parser."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from ..functions.matchers import Matcher, selective
from ..model import NAME, QueryError

AGGREGATORS = {"sum", "avg", "count", "min", "max", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "group"}
_WITH_PARAMETER = {"topk", "bottomk", "quantile", "count_values"}
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_DURATION = r"(?:\d+(?:ms|[smhdwy]))+"
_TOKEN = re.compile(
    rf"""(?P<space>\s+|\#[^\n]*)
    |(?P<duration>{_DURATION}(?![\w]))
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w]))
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`[^`]*`)
    |(?P<word>[a-zA-Z_:][\w:]*)
    |(?P<op>==|!=|=~|!~|<=|>=|[-+*/%^=<>(){{}}\[\],:@])""",
    re.VERBOSE,
)
_BINARY = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
COMPARISONS = {"==", "!=", "<", ">", "<=", ">="}
SETS = {"and", "or", "unless"}


@dataclass(frozen=True)
class At:
    """Pinned evaluation: a time in ms, or start or end of the query."""

    ms: int | None = None
    edge: str = ""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class String:
    value: str


@dataclass(frozen=True)
class Selector:
    matchers: tuple[Matcher, ...]
    window: int | None = None
    offset: int = 0
    at: At | None = None


@dataclass(frozen=True)
class Subquery:
    expr: Expr
    window: int
    step: int | None
    offset: int = 0
    at: At | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregate:
    op: str
    expr: Expr
    parameter: Expr | None
    labels: tuple[str, ...]
    without: bool


@dataclass(frozen=True)
class Unary:
    op: str
    expr: Expr


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    side: str = ""  # left or right: the many side
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr
    boolean: bool = False
    matching: Matching = field(default_factory=Matching)


Expr = Number | String | Selector | Subquery | Call | Aggregate | Unary | Binary


def duration_ms(text: str) -> int:
    """1h30m and the like; units fall and occur once."""
    if not re.fullmatch(_DURATION, text):
        raise QueryError(f"not a valid duration string: {text!r}")
    parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
    sizes = [_UNITS[u] for _, u in parts]
    if any(a <= b for a, b in zip(sizes, sizes[1:], strict=False)):
        raise QueryError(f"not a valid duration string: {text!r}")
    total = sum(int(n) * s for (n, _), s in zip(parts, sizes, strict=True))
    if total >= 1 << 63:
        raise QueryError("duration out of range")
    return total


def selectors(e: Expr) -> list[list[Matcher]]:
    """The matchers of every selector in an expression."""
    match e:
        case Selector():
            return [list(e.matchers)]
        case Subquery() | Unary():
            return selectors(e.expr)
        case Aggregate():
            return selectors(e.expr) + (selectors(e.parameter) if e.parameter is not None else [])
        case Call():
            return [m for x in e.args for m in selectors(x)]
        case Binary():
            return selectors(e.left) + selectors(e.right)
    return []


def kind(e: Expr) -> str:
    """scalar, vector, matrix or string."""
    match e:
        case Number():
            return "scalar"
        case String():
            return "string"
        case Selector():
            return "vector" if e.window is None else "matrix"
        case Subquery():
            return "matrix"
        case Call():
            return "scalar" if e.name in ("scalar", "time", "pi") else "vector"
        case Unary():
            return kind(e.expr)
        case Binary():
            return "scalar" if kind(e.left) == kind(e.right) == "scalar" else "vector"
    return "vector"


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, inside = 0, False
        while at < len(text):
            if inside and text[at] == ":":  # in a range, not the start of a name
                self.tokens.append(("op", ":"))
                at += 1
                continue
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"parse error: unexpected character {text[at]!r} at {at}")
            inside = m.group() == "[" or (inside and m.group() != "]")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, *values: str) -> str | None:
        if self.now[0] in ("op", "word") and self.now[1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise QueryError(f"parse error: expected {value!r}, found {self.now[1] or 'end of input'!r}")

    def kind(self, group: str, what: str) -> str:
        if self.now[0] != group:
            raise QueryError(f"parse error: expected {what}, found {self.now[1] or 'end of input'!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Expr:
        e = self.expr(0)
        if self.now[0] != "end":
            raise QueryError(f"parse error: unexpected {self.now[1]!r}")
        return e

    def expr(self, least: int) -> Expr:
        left = self.unary()
        while self.now[0] in ("op", "word") and (level := _BINARY.get(self.now[1].lower(), 0)) > least:
            op = self.now[1].lower()
            self.at += 1
            boolean = op in COMPARISONS and bool(self.take("bool"))
            matching = self.matching()
            right = self.expr(level - 1 if op == "^" else level)
            left = self.binary(op, left, right, boolean, matching)
        return left

    def binary(self, op: str, left: Expr, right: Expr, boolean: bool, matching: Matching) -> Binary:
        kinds = kind(left), kind(right)
        if any(k not in ("scalar", "vector") for k in kinds):
            raise QueryError("parse error: binary expression must contain only scalar and instant vector types")
        if op in SETS and "scalar" in kinds:
            raise QueryError(f"parse error: set operator {op!r} not allowed in binary scalar expression")
        if op in SETS and matching.side:
            raise QueryError(f"parse error: no grouping allowed for {op!r} operation")
        if kinds == ("scalar", "scalar") and op in COMPARISONS and not boolean:
            raise QueryError("parse error: comparisons between scalars must use BOOL modifier")
        return Binary(op, left, right, boolean, matching)

    def matching(self) -> Matching:
        m = Matching()
        if word := self.take("on", "ignoring"):
            m = Matching(word == "on", self.labels())
            if side := self.take("group_left", "group_right"):
                include = self.labels() if self.now[1] == "(" else ()
                if m.on and set(include) & set(m.labels):
                    raise QueryError("parse error: a label must not occur in ON and GROUP clause at once")
                m = replace(m, side=side.removeprefix("group_"), include=include)
        return m

    def labels(self) -> tuple[str, ...]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.kind("word", "a label name"))
            if not self.take(","):
                self.need(")")
                break
        return tuple(out)

    def unary(self) -> Expr:
        if op := self.take("+", "-"):
            e = self.expr(5)  # binds less than ^
            if kind(e) not in ("scalar", "vector"):
                raise QueryError("parse error: unary expression only allowed on expressions of type scalar or instant vector")
            if isinstance(e, Number):
                return Number(-e.value if op == "-" else e.value)
            return Unary(op, e)
        return self.postfix(self.primary())

    def postfix(self, e: Expr) -> Expr:
        while True:
            if self.take("["):
                window = self.span()
                if self.take(":"):
                    step = self.span() if self.now[1] != "]" else None
                    self.need("]")
                    if kind(e) not in ("vector", "scalar"):
                        raise QueryError("parse error: subquery is only allowed on instant vector")
                    e = Subquery(e, window, step)
                else:
                    self.need("]")
                    if not isinstance(e, Selector) or e.window is not None or e.offset or e.at:
                        raise QueryError("parse error: ranges only allowed for vector selectors")
                    e = replace(e, window=window)
            elif self.take("offset"):
                sign = -1 if self.take("-") else 1
                if not isinstance(e, (Selector, Subquery)) or e.offset:
                    raise QueryError("parse error: offset modifier must be preceded by a selector or subquery, once")
                e = replace(e, offset=sign * self.span())
            elif self.take("@"):
                if not isinstance(e, (Selector, Subquery)) or e.at:
                    raise QueryError("parse error: @ modifier must be preceded by a selector or subquery, once")
                if edge := self.take("start", "end"):
                    self.need("(")
                    self.need(")")
                    e = replace(e, at=At(edge=edge))
                else:
                    sign = -1 if self.take("-") else 1
                    value = self.number(self.now[1]) if self.now[0] == "number" else math.nan
                    self.at += 1
                    if not math.isfinite(value):
                        raise QueryError("parse error: timestamp must not be infinite or NaN for @ modifier")
                    e = replace(e, at=At(ms=round(sign * value * 1000)))
            else:
                return e

    def span(self) -> int:
        """A duration, or a number of seconds."""
        group, text = self.now
        self.at += 1
        if group == "duration":
            return duration_ms(text)
        if group == "number":
            return round(self.number(text) * 1000)
        raise QueryError(f"parse error: expected a duration, found {text!r}")

    @staticmethod
    def number(text: str) -> float:
        return float(int(text, 16)) if text[:2] in ("0x", "0X") else float(text)

    def primary(self) -> Expr:
        group, text = self.now
        if group == "number":
            self.at += 1
            return Number(self.number(text))
        if group == "duration":
            self.at += 1
            return Number(duration_ms(text) / 1000)
        if group == "string":
            self.at += 1
            return String(unquoted(text))
        if self.take("("):
            e = self.expr(0)
            self.need(")")
            return e
        if text == "{":
            return self.selector(None)
        if group == "word":
            self.at += 1
            low = text.lower()
            following = self.now[1]
            if low in ("inf", "nan") and following not in ("{", "("):
                return Number(float(low))
            if low in AGGREGATORS and (following in ("(", "by", "without")):
                return self.aggregate(low)
            if following == "(":
                return self.call(text)
            return self.selector(text)
        raise QueryError(f"parse error: unexpected {text or 'end of input'!r}")

    def selector(self, name: str | None) -> Selector:
        matchers = [Matcher(NAME, "=", name)] if name else []
        if self.take("{"):
            while not self.take("}"):
                if self.now[0] == "string":
                    matchers.append(Matcher(NAME, "=", unquoted(self.kind("string", "a name"))))
                else:
                    label = self.kind("word", "a label name")
                    if label == NAME and name:
                        raise QueryError("parse error: metric name must not be set twice")
                    op = self.take("=", "!=", "=~", "!~")
                    if not op:
                        raise QueryError(f"parse error: expected a label matching operator, found {self.now[1]!r}")
                    matchers.append(Matcher(label, op, unquoted(self.kind("string", "a string"))))
                if not self.take(","):
                    self.need("}")
                    break
        if not selective(matchers):
            raise QueryError("parse error: vector selector must contain at least one non-empty matcher")
        return Selector(tuple(matchers))

    def aggregate(self, op: str) -> Aggregate:
        group = self.grouping()
        self.need("(")
        args = [self.expr(0)]
        while self.take(","):
            args.append(self.expr(0))
        self.need(")")
        group = group or self.grouping() or ((), False)
        if len(args) != (2 if op in _WITH_PARAMETER else 1):
            raise QueryError(f"parse error: wrong number of arguments for aggregate expression {op}")
        if kind(args[-1]) != "vector":
            raise QueryError("parse error: expected type instant vector in aggregation expression")
        if len(args) == 2 and kind(args[0]) != ("string" if op == "count_values" else "scalar"):
            raise QueryError(f"parse error: wrong type of parameter of {op}")
        return Aggregate(op, args[-1], args[0] if len(args) == 2 else None, *group)

    def grouping(self) -> tuple[tuple[str, ...], bool] | None:
        if word := self.take("by", "without"):
            return self.labels(), word == "without"
        return None

    def call(self, name: str) -> Call:
        from .functions import SIGNATURES

        if name not in SIGNATURES:
            raise QueryError(f"parse error: unknown function with name {name!r}")
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.expr(0))
            if not self.take(","):
                self.need(")")
                break
        wanted, optional = SIGNATURES[name]
        if not len(wanted) - optional <= len(args) <= len(wanted):
            raise QueryError(f"parse error: wrong number of arguments in call to {name}")
        for a, k in zip(args, wanted, strict=False):
            if kind(a) != k:
                raise QueryError(f"parse error: expected type {k} in call to function {name!r}, got {kind(a)}")
        return Call(name, tuple(args))


def unquoted(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]
    plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}

    def one(m: re.Match[str]) -> str:
        x = m.group(1)
        return chr(int(x[1:], 16)) if x[0] in "xuU" and len(x) > 1 else plain.get(x, x)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text[1:-1], flags=re.DOTALL)


def parse(text: str) -> Expr:
    if not text.strip():
        raise QueryError("unknown position: parse error: no expression found in input")
    return Parser(text).whole()
