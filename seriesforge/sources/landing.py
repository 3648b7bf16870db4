"""Blocks of raw samples that wait for conversion: which ones count, their streams, and the loop that converts them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame

from ..functions.matchers import Matcher
from ..model import day_start
from .store import Source, Store, plan, stream_hash


@dataclass(frozen=True)
class Landed:
    """A block's metadata: times in [mint, maxt), its external labels, and what decides whether it counts."""

    name: str
    mint: int
    maxt: int
    external: dict[str, str] = field(default_factory=dict, hash=False)
    resolution_ms: int = 0
    chunks: int = 1
    complete: bool = True
    marked: bool = False
    uploaded_ms: int = 0


def eligible(found: list[Landed], matchers: tuple[Matcher, ...] = (), now_ms: int = 0, min_age_ms: int = 0) -> list[Landed]:
    """Complete blocks of raw resolution with samples, not marked for deletion, old enough, of matching streams."""
    return [
        b for b in found
        if b.complete and not b.marked and b.resolution_ms == 0 and b.chunks > 0 and (not min_age_ms or b.uploaded_ms <= now_ms - min_age_ms)
        and all(m.matches(b.external.get(m.name, "")) for m in matchers)
    ]


def streams(found: list[Landed]) -> list[tuple[dict[str, str], list[Landed]]]:
    """Blocks by external labels, in the order of these."""
    by: dict[tuple, list[Landed]] = {}
    for b in found:
        by.setdefault(tuple(sorted(b.external.items())), []).append(b)
    return [(dict(k), v) for k, v in sorted(by.items())]


def convert_landed(store: Store, found: list[Landed], load: Callable[[str], DataFrame], not_after: date, max_days: int = 0) -> list[tuple[int, date]]:
    """Plan and convert what is missing, stream by stream, newest day first; (stream, day) of what was written.

    `load` gives a block's samples; a block that several days need is loaded once, its days read it lazily.
    """
    out = []
    have = [(r["stream_hash"], r["day"]) for r in store.blocks().select("stream_hash", "day").collect()]
    for external, blocks in streams(found):
        stream = stream_hash(store.spark, external)
        sources = {b.name: Source(b.name, b.mint, b.maxt) for b in blocks}
        opened: dict[str, DataFrame] = {}
        for day, need in plan(list(sources.values()), [d for s, d in have if s == stream], not_after, max_days):
            rows = None
            for s in need:
                part = opened.setdefault(s.name, load(s.name))
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            low, high = day_start(day), day_start(day + timedelta(days=1))
            if rows.where(rows["ts_ms"].between(low, high - 1)).isEmpty():
                continue
            store.convert(rows, external, [s.name for s in need], low, high)
            out.append((stream, day))
    return out
