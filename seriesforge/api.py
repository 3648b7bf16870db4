"""Query API: parameters in, JSON envelopes out, over a Storage."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import functions as F

from .functions.matchers import Matcher
from .model import Grid, QueryError, Warnings, labels_map
from .operators.select import Storage
from .plans.compiler import Query, compile_query
from .plans.parser import Selector, duration_ms, parse, selectors

# Statuses and error types of the API.
_STATUS = {"bad_request": 400, "resource_exhausted": 400, "unimplemented": 404, "timeout": 408, "canceled": 408, "internal": 500}


def time_ms(text: str) -> int:
    """Unix seconds, or RFC 3339 with its zone."""
    try:
        value = float(text)
        if not math.isfinite(value):
            raise QueryError(f"cannot parse {text!r} to a valid timestamp")
        return round(value * 1000)
    except ValueError:
        pass
    try:
        value = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if value.tzinfo is None:
            raise ValueError
        return round(value.timestamp() * 1000)
    except ValueError:
        raise QueryError(f"cannot parse {text!r} to a valid timestamp") from None


def step_ms(text: str) -> int:
    """Seconds or a duration."""
    try:
        value = float(text) * 1000
        if not abs(value) < 2**63:
            raise QueryError(f"cannot parse {text!r} to a valid duration. It overflows int64")
        return round(value)
    except ValueError:
        return duration_ms(text)


def number(value: float) -> str:
    """Of a sample in JSON."""
    if value != value:
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def buckets(h) -> dict:
    """Of a native histogram in JSON; a bucket says which of its bounds it holds: 0 the upper, 1 the lower, 3 both."""
    bound = lambda i: 2.0 ** (i * 2.0 ** -h["schema"])
    out = [(1, -bound(b["i"]), -bound(b["i"] - 1), b["c"]) for b in reversed(h["neg"])]
    out += [(3, -h["zero_threshold"] or 0.0, h["zero_threshold"], h["zero_count"])] if h["zero_count"] else []
    out += [(0, bound(b["i"] - 1), bound(b["i"]), b["c"]) for b in h["pos"]]
    shown = {"count": number(h["count"]), "sum": number(h["sum"])}
    return shown | ({"buckets": [[rule, *map(number, x)] for rule, *x in out]} if out else {})


@dataclass
class Api:
    """timeout_ms: longest time of a query, 0 for any; a request may ask for less.

    max_samples: most samples that a result may have, 0 for any number; concurrency: queries at a time, 0 for any number."""

    storage: Storage
    default_step_ms: int = 30_000
    max_samples: int = 10_000_000
    concurrency: int = 100
    subquery_step_ms: int = 60_000
    timeout_ms: int = 30_000
    _gate: threading.BoundedSemaphore | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self._gate = threading.BoundedSemaphore(self.concurrency) if self.concurrency else None

    def handle(self, path: str, **params: str | list[str]) -> tuple[int, dict]:
        """Status and envelope of a request to /api/v1/..."""
        self.storage.warnings = Warnings()
        try:
            if self._gate:
                self._gate.acquire()
            try:
                data = self._timed(path.removeprefix("/api/v1"), params)
            finally:
                if self._gate:
                    self._gate.release()
        except QueryError as e:
            return _STATUS[e.kind], {"status": "error", "errorType": e.kind, "error": str(e)}
        out = {"status": "success", "data": data}
        return 200, out | ({"warnings": self.storage.warnings.messages} if self.storage.warnings.messages else {})

    def _timed(self, path: str, params: dict) -> object:
        """_route() in a job group of its own, which is cancelled when the time is over."""
        asked = step_ms(params["timeout"]) if "timeout" in params else 0
        limit = min(filter(None, (asked, self.timeout_ms)), default=0)
        if not limit:
            return self._route(path, params)
        context, group, over = self.storage.samples.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            over.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(limit / 1000, stop)
        context.setJobGroup(group, path, interruptOnCancel=True)
        timer.start()
        try:
            data = self._route(path, params)
            if over.is_set():
                raise QueryError("query timed out in expression evaluation", "timeout")
            return data
        except QueryError:
            raise
        except Exception as e:
            if over.is_set():
                raise QueryError("query timed out in expression evaluation", "timeout") from e
            raise QueryError(str(e).splitlines()[0] if str(e) else type(e).__name__, "internal") from e
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def json(self, path: str, **params: str | list[str]) -> str:
        return json.dumps(self.handle(path, **params)[1])

    def _route(self, path: str, p: dict) -> object:
        if path == "/query":
            return self.query(p.get("query", ""), Grid.instant(time_ms(p["time"]) if "time" in p else round(time.time() * 1000)), instant=True)
        if path == "/query_range":
            step = step_ms(p["step"]) if "step" in p else self.default_step_ms
            if step <= 0:
                raise QueryError("zero or negative query resolution step widths are not accepted. Try a positive integer")
            return self.query(p.get("query", ""), Grid(time_ms(p.get("start", "")), time_ms(p.get("end", "")), step), instant=False)
        low, high = (time_ms(p[x]) if x in p else None for x in ("start", "end"))
        if low is not None and high is not None and high < low:
            raise QueryError("end timestamp must not be before start time")
        limit = int(p.get("limit", 0))
        selectors = [self.selector(x) for x in ([p["match[]"]] if isinstance(p.get("match[]"), str) else p.get("match[]", []))]
        if path == "/series":
            if not selectors:
                raise QueryError("no match[] parameter provided")
            rows = self.storage.series(*selectors, low=low, high=high, limit=limit)
            return [dict(r[0]) for r in rows.select(labels_map(self.storage.labels)).collect()]
        if path == "/labels":
            return sorted({r[0] for s in selectors or [[]] for r in self.storage.label_names(s, low, high, limit).collect()})[: limit or None]
        if m := re.fullmatch(r"/label/([^/]*)/values", path):
            if not re.fullmatch(r"[a-zA-Z_]\w*", m[1]):
                raise QueryError(f"invalid label name: {m[1]!r}")
            return sorted({r[0] for s in selectors or [[]] for r in self.storage.label_values(m[1], s, low, high, limit).collect()})[: limit or None]
        raise QueryError(f"no route {path}", "unimplemented")

    @staticmethod
    def selector(text: str) -> list[Matcher]:
        e = parse(text)
        if not isinstance(e, Selector) or e.window is not None:
            raise QueryError("match[] must be a series selector")
        return list(e.matchers)

    def query(self, text: str, grid: Grid, instant: bool) -> dict:
        q = compile_query(self.storage, text, grid, self.subquery_step_ms)
        if self.storage.hidden:  # series may be merged after external labels were set
            any(self.storage.conflicts(m) for m in selectors(parse(text)))
        own = [q.ordered().select("step", "value", labels_map(q.labels).alias("metric"))]
        if q.histograms:
            own.append(Query(q.kind, q.histograms.df, q.histograms.labels).ordered().select("step", F.col("value").alias("hist"), labels_map(q.histograms.labels).alias("metric")))
        found = []
        for rows in own:
            found += (rows.limit(self.max_samples + 1) if self.max_samples else rows).collect()
        if self.max_samples and len(found) > self.max_samples:
            raise QueryError("query processing would load too many samples into memory", "resource_exhausted")

        def sample(r) -> tuple[str, list]:
            return ("histogram", [r["step"] / 1000, buckets(r["hist"])]) if "hist" in r else ("value", [r["step"] / 1000, number(r["value"])])

        if instant and q.kind == "scalar":
            return {"resultType": "scalar", "result": sample(found[0])[1]}
        if instant and q.kind == "vector":
            return {"resultType": "vector", "result": [{"metric": dict(r["metric"]), **dict([sample(r)])} for r in found]}
        series: dict[tuple, dict[str, list]] = {}
        for r in found:
            kind, x = sample(r)
            series.setdefault(tuple(sorted(r["metric"].items())), {}).setdefault(kind + "s", []).append(x)
        return {"resultType": "matrix", "result": [{"metric": dict(k), **v} for k, v in series.items()]}

    def info(self) -> dict:
        """Smallest and largest time, and the external labels."""
        r = self.storage.samples.agg(F.min("ts_ms"), F.max("ts_ms")).first()
        return {"mint": r[0], "maxt": r[1], "labels": {k: v for k, v in self.storage.external.items() if k not in self.storage.replica}}
