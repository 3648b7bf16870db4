"""Days, closed intervals, evaluation grids, series identity, warnings and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
PREFIX = "l_"
#: Of samples whose ts_ms is computed: the stored timestamp without zone, which bounds of time can be pushed to.
STORED_TIME = "at_ntz"
HIST = "hist"
DAY_MS = 86_400_000
SLOT_MS = 8 * 3_600_000


class QueryError(Exception):
    """kind is one of bad_request, internal, resource_exhausted, unimplemented, timeout, canceled."""

    def __init__(self, message: str, kind: str = "bad_request") -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class Warnings:
    """Messages that travel beside a result."""

    messages: list[str] = field(default_factory=list)

    def add(self, message: str) -> None:
        if message not in self.messages:
            self.messages.append(message)


@dataclass(frozen=True)
class Interval:
    """Closed at both ends, milliseconds."""

    low: int
    high: int

    def intersects(self, other: Interval) -> bool:
        return self.low <= other.high and other.low <= self.high

    def contains(self, t: int) -> bool:
        return self.low <= t <= self.high

    def intersection(self, other: Interval) -> Interval | None:
        return Interval(max(self.low, other.low), min(self.high, other.high)) if self.intersects(other) else None


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0:
            raise QueryError("zero or negative query resolution step widths are not accepted")
        if self.end < self.start:
            raise QueryError("end timestamp must not be before start time")

    @classmethod
    def instant(cls, t: int) -> Grid:
        return cls(t, t, 1)

    @property
    def last(self) -> int:
        return self.start + (self.end - self.start) // self.step * self.step

    def times(self) -> Column:
        return F.sequence(F.lit(self.start), F.lit(self.last), F.lit(self.step)).cast("array<bigint>")


def ntz(ts_ms: int) -> Column:
    """A constant timestamp without zone."""
    return F.expr(f"timestampadd(MILLISECOND, {ts_ms}L, timestamp_ntz'1970-01-01 00:00:00')")


def day_of(ts_ms: int) -> date:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ts_ms)).date()


def day_start(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp()) * 1000


def days(low: int, high: int) -> list[date]:
    """UTC days that [low, high) touches; an end at midnight belongs to the day before."""
    first, last = day_of(low), day_of(max(low, high - 1))
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def slot(ts_ms: Column) -> Column:
    """Number of the 8-hour part of a UTC day."""
    return F.pmod(F.floor(ts_ms / SLOT_MS), F.lit(3)).cast("int")


def label_columns(columns: list[str]) -> list[str]:
    return [c[len(PREFIX) :] for c in columns if c.startswith(PREFIX)]


def column(label: str) -> str:
    return PREFIX + label


def label(name: str) -> Column:
    return F.col(f"`{PREFIX}{name}`")


def series_id(labels: list[str]) -> Column:
    """Hash of a label set: absent labels do not count. Lengths stand before values, so none can imitate another label."""
    present = F.array_compact(F.array(*(F.when(label(x).isNotNull(), F.concat(F.lit(x + "="), F.length(label(x)).cast("string"), F.lit(":"), label(x))) for x in sorted(labels))))
    return F.xxhash64(F.array_join(present, ","))


def labels_map(labels: list[str]) -> Column:
    """Present labels as a map, for the edge of the API."""
    return F.map_filter(F.create_map(*(x for n in sorted(labels) for x in (F.lit(n), label(n)))), lambda _, v: v.isNotNull()) if labels else F.create_map().cast("map<string,string>")
