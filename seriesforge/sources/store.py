"""The day-partitioned store: conversion, planning, discovery, retention, and reading it back.

Layout under a root: samples/ and series/ partitioned by write, stream_hash and day, streams/ (external labels by hash)
and blocks/ (one row per written day, appended last: the commit point). A write never touches what others wrote: a later
one for the same day reads the day, merges it with what is new and commits the result under its own name. So a write
that fails, or is tried again, changes nothing that is seen, and equal samples that arrive twice are stored once.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DAY_MS, HIST, SLOT_MS, STORED_TIME, Interval, QueryError, column, day_of, day_start, days, label, label_columns, series_id, slot
from ..operators.select import Storage

BLOCKS = "stream_hash bigint, day date, version int, mint bigint, maxt bigint, series bigint, samples bigint, sources array<string>, write string, deletion_marked_at bigint"
STREAMS = "stream_hash bigint, external_labels string"
#: Samples that a task of a conversion sorts and writes.
ROWS_A_TASK = 1 << 19


def day_column() -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_ms") / DAY_MS).cast("int"))


def days_of_streams(samples: DataFrame) -> DataFrame:
    """day, number of series and of samples."""
    ids = series_id(label_columns(samples.columns))
    per = samples.groupBy(day_column().alias("day"), ids.alias("id")).agg(F.count("*").alias("n"))
    return per.groupBy("day").agg(F.count("*").alias("series"), F.sum("n").alias("samples"))


def stream_hash(spark: SparkSession, external: dict[str, str]) -> int:
    """0 without external labels."""
    if not external:
        return 0
    text = json.dumps(sorted(external.items()))
    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


@dataclass(frozen=True)
class Source:
    """A block of raw samples: name, times in [mint, maxt)."""

    name: str
    mint: int
    maxt: int

    def covers(self, day: date) -> bool:
        return self.mint <= day_start(day) and day_start(day + timedelta(days=1)) <= self.maxt


def plan(sources: list[Source], done: list[date], not_after: date, max_days: int = 0) -> list[tuple[date, list[Source]]]:
    """Days to convert, newest first, each with the sources that it needs.

    Days before `not_after` that no block has; the newest one is left out unless the sources cover it whole. `max_days` is soft:
    further days follow while they need no source that was not taken already.
    """
    wanted = sorted({d for s in sources for d in days(s.mint, s.maxt)} - set(done), reverse=True)
    wanted = [d for d in wanted if d < not_after]
    if wanted:
        newest = wanted[0]
        reach = day_start(newest)
        for s in sorted(sources, key=lambda s: s.mint):
            if s.mint <= reach < s.maxt:
                reach = s.maxt
        if reach < day_start(newest + timedelta(days=1)):
            wanted = wanted[1:]
    out: list[tuple[date, list[Source]]] = []
    taken: set[Source] = set()
    for d in wanted:
        need = [s for s in sources if d in days(s.mint, s.maxt)]
        if max_days and len(out) >= max_days and not set(need) <= taken:
            break
        taken |= set(need)
        out.append((d, need))
    return out


def vectored_ranges(parts: list[tuple[int, int]], max_range: int, max_gap: int) -> list[tuple[int, int]]:
    """Sorted byte ranges joined while their span is at most max_range and their gap at most max_gap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a - out[-1][1] <= max_gap and max(b, out[-1][1]) - out[-1][0] <= max_range:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.schema(schema).parquet(path) if schema else self.spark.read.option("mergeSchema", True).parquet(path)

    def _history(self) -> DataFrame:
        return self._read("blocks", BLOCKS + ", written bigint")

    def blocks(self) -> DataFrame:
        """Latest row of each block; a later row replaces an earlier one."""
        rows = self._history()
        order = F.struct("written", F.coalesce("deletion_marked_at", F.lit(0)), F.coalesce("write", F.lit("")))
        best = F.max_by(F.struct(*[c for c in rows.columns if c not in ("stream_hash", "day")]), order).alias("b")
        return rows.groupBy("stream_hash", "day").agg(best).select("stream_hash", "day", "b.*").drop("written")

    def _parts(self, name: str, rows: list) -> DataFrame:
        """The stored rows of blocks: a predicate on partition columns only."""
        by: dict[tuple[int, str], list[date]] = {}
        for r in rows:
            by.setdefault((r["stream_hash"], r["write"]), []).append(r["day"])
        here = F.lit(False)
        for (stream, write), found in sorted(by.items()):
            here |= (F.col("stream_hash") == stream) & (F.col("write") == write) & F.col("day").isin(found)
        return self._read(name).where(here)

    def streams(self) -> dict[int, dict[str, str]]:
        return {r[0]: json.loads(r[1]) for r in self._read("streams", STREAMS).distinct().collect()}

    def convert(self, samples: DataFrame, external: dict[str, str], sources: list[str], low: int | None = None, high: int | None = None, sort_labels: tuple[str, ...] = ("__name__",), series_per_file: int = 1_000_000) -> list[date]:
        """Write the days of `samples` (in [low, high)) as blocks of one stream; equal series and times are merged.

        Days that the stream has already are merged with what they hold. Samples and series are merged apart, by day and
        series_id, so neither is joined with the other. `samples` is read three times (days, samples, series), not kept.
        """
        stream = stream_hash(self.spark, external)
        known = self.streams()
        if stream in known and known[stream] != external:
            raise QueryError(f"stream {stream} has other external labels", "bad_request")
        if low is not None:
            samples = samples.where(F.col("ts_ms") >= low)
        if high is not None:
            samples = samples.where(F.col("ts_ms") < high)
        for n in label_columns(samples.columns):  # absent and empty are one
            samples = samples.withColumn(column(n), F.when(label(n) != "", label(n)))
        sizes = {r["day"]: r["n"] for r in samples.groupBy(day_column().alias("day")).agg(F.count("*").alias("n")).collect()}
        if not sizes:
            raise QueryError("no series to convert", "bad_request")
        there = [r for r in self.blocks().where((F.col("stream_hash") == stream) & F.col("deletion_marked_at").isNull()).collect() if r["day"] in sizes]
        for r in there:
            sizes[r["day"]] += r["samples"]
        write = f"w{uuid.uuid4().hex}"
        self._write_samples(samples, there, sizes, write, stream)
        self._write_series(samples, there, write, stream, sort_labels, series_per_file)
        written = lambda name: self.spark.read.schema("ts_ms bigint, day date").parquet(f"{self.root}/{name}/write={write}").groupBy("day")
        series = {r["day"]: r["n"] for r in written("series").agg(F.count("*").alias("n")).collect()}
        counts = written("samples").agg(F.min("ts_ms").alias("mint"), F.max("ts_ms").alias("maxt"), F.count("*").alias("samples")).collect()
        if stream not in known:
            self.spark.createDataFrame([(stream, json.dumps(external))], STREAMS).write.mode("append").parquet(f"{self.root}/streams")
        before = {r["day"]: list(r["sources"] or []) for r in there}
        self._append([(stream, r["day"], 2, r["mint"], r["maxt"], series[r["day"]], r["samples"], sorted({*before.get(r["day"], []), *sources}), write, None) for r in counts])
        return sorted(r["day"] for r in counts)

    def _write_samples(self, samples: DataFrame, there: list, sizes: dict[date, int], write: str, stream: int) -> None:
        """By day, series_id and time, merged with those of the blocks `there`; `sizes` has at least the days' rows.

        Ids are hashes, evenly spread, so the days' rows tell where tasks of equal size begin: one shuffle, whose order
        both merges samples and is written.
        """
        names = label_columns(samples.columns)
        stale = F.col("is_stale") if "is_stale" in samples.columns else F.lit(False)
        rest = [c for c in samples.columns if c not in ("ts_ms", "value", "is_stale", HIST, STORED_TIME, *(column(x) for x in names))]
        kinds = ["value", *([HIST] if HIST in samples.columns else [])]
        # which of equal times counts is told as in Storage.shown(), by the source's order unless some are stored already
        tie = F.struct(*sorted([*rest, *kinds[1:]])) if rest and not there else F.lit(None).cast("int")
        rows = samples.select(day_column().alias("day"), series_id(names).alias("series_id"), "ts_ms", *kinds, stale.alias("is_stale"), tie.alias("tie"))
        if there:
            rows = self._parts("samples", there).drop("write", "stream_hash", "slot").unionByName(rows, allowMissingColumns=True)
            kinds = ["value", *([HIST] if HIST in rows.columns else [])]
        best = F.min(F.struct("tie", *kinds[1:], F.isnan("value").alias("nan"), "value", "is_stale")).alias("best")
        spans, total = [], 0
        for d in sorted(sizes):
            spans.append((d, total, sizes[d]))
            total += sizes[d]
        places = F.broadcast(self.spark.createDataFrame(spans, "day date, first bigint, size bigint"))
        share = F.col("series_id") / float(1 << 64) + 0.5
        rows = rows.join(places, "day").withColumn("part", F.floor((F.col("first") + F.col("size") * share) / ROWS_A_TASK).cast("int")).drop("first", "size")
        merged = rows.repartitionById(total // ROWS_A_TASK + 1, F.col("part")).groupBy("part", "day", "series_id", "ts_ms").agg(best)
        out = merged.select("day", "series_id", slot(F.col("ts_ms")).alias("slot"), "ts_ms", *(F.col(f"best.{x}").alias(x) for x in kinds), "best.is_stale")
        out = out.sortWithinPartitions("day", "series_id", "ts_ms").withColumns({"write": F.lit(write), "stream_hash": F.lit(stream)})
        out.write.mode("append").partitionBy("write", "stream_hash", "day").parquet(f"{self.root}/samples")

    def _write_series(self, samples: DataFrame, there: list, write: str, stream: int, sort_labels: tuple[str, ...], series_per_file: int) -> None:
        """By day and `sort_labels`, with their first and last times, merged with those of the blocks `there`."""
        rows = samples.select(day_column().alias("day"), *(label(x) for x in label_columns(samples.columns)), F.col("ts_ms").alias("mint"), F.col("ts_ms").alias("maxt"))
        if there:
            rows = self._parts("series", there).drop("write", "stream_hash", "series_id").unionByName(rows, allowMissingColumns=True)
        names = label_columns(rows.columns)
        series = rows.groupBy("day", *(label(x) for x in names)).agg(F.min("mint").alias("mint"), F.max("maxt").alias("maxt"))
        series = series.select("day", series_id(names).alias("series_id"), *(label(x) for x in names), "mint", "maxt")
        order = ["day", *(label(x) for x in sort_labels if x in names), "series_id"]
        out = series.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"write": F.lit(write), "stream_hash": F.lit(stream)})
        out.write.option("maxRecordsPerFile", series_per_file).option("parquet.bloom.filter.enabled#l___name__", "true").mode("append").partitionBy("write", "stream_hash", "day").parquet(f"{self.root}/series")

    def _append(self, rows: list[tuple]) -> None:
        """Later rows have larger numbers, even if the clock was set back."""
        last = self._history().agg(F.max("written")).first()[0] or 0
        now = max(time.time_ns() // 1000, last + 1)
        self.spark.createDataFrame(rows, T._parse_datatype_string(BLOCKS)).coalesce(1).withColumn("written", F.lit(now).cast("bigint")).write.mode("append").parquet(f"{self.root}/blocks")

    def discover(self, hide: Interval | None = None) -> DataFrame:
        """Visible blocks: committed, of a known stream, not marked for deletion, not wholly inside `hide`."""
        known = self._read("streams", STREAMS).select("stream_hash").distinct()
        rows = self.blocks().where("deletion_marked_at is null").join(known, "stream_hash", "left_semi")
        return rows if hide is None else rows.where(~((F.col("mint") >= hide.low) & (F.col("maxt") <= hide.high)))

    def mark_expired(self, now_ms: int, retention_ms: int) -> int:
        """Mark days before now - retention; returns how many are new."""
        edge = day_of(now_ms - retention_ms)
        rows = self.blocks().where("deletion_marked_at is null").where(F.col("day") < F.lit(edge)).collect()
        if rows:
            names = [f.name for f in T._parse_datatype_string(BLOCKS)]
            self._append([tuple(now_ms if n == "deletion_marked_at" else r[n] for n in names) for r in rows])
        return len(rows)

    def delete_marked(self, now_ms: int, delay_ms: int = 12 * 3_600_000) -> list[date]:
        """Drop the data of blocks marked for `delay_ms`; days whose data went."""
        rows = self.blocks().where(F.col("deletion_marked_at") <= now_ms - delay_ms).collect()
        return sorted({r["day"] for r in rows if self._drop(r)})

    def sweep(self, now_ms: int, delay_ms: int = 12 * 3_600_000) -> int:
        """Drop the data of days that a later write replaced over `delay_ms` ago; returns how many."""
        now = {(r["stream_hash"], r["day"]): r["write"] for r in self.blocks().collect()}
        written = F.max("written").over(Window.partitionBy("stream_hash", "day"))
        old = self._history().withColumn("last", written).where(F.col("last") <= (now_ms - delay_ms) * 1000).select("stream_hash", "day", "write").distinct().collect()
        return sum(self._drop(r) for r in old if r["write"] != now[r["stream_hash"], r["day"]])

    def _drop(self, row) -> bool:
        found = False
        for name in ("series", "samples"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/write={row['write']}/stream_hash={row['stream_hash']}/day={row['day']}")
            found |= path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return found

    def open(self, stream: int, low: int, high: int, external: dict[str, str] | None = None, **options) -> Storage:
        """A stream's samples between two times, with its external labels or those given instead.

        Only days with a visible block, and their 8-hour slots that the times touch, are read; metadata comes from the
        series alone. Stored samples are unique, so queries do not merge them again.
        """
        wanted = self.discover().where((F.col("stream_hash") == stream) & (F.col("mint") <= high) & (F.col("maxt") >= low)).collect()
        if self._read("series") is None:
            raise QueryError("the store is empty", "unimplemented")
        keys = ["write", "stream_hash", "day", "series_id"]
        series = self._parts("series", wanted)
        values = self._parts("samples", wanted).where(F.col("ts_ms").between(low, high))
        if day_start(day_of(low)) == day_start(day_of(high)):  # within a day, slots are a range
            values = values.where(F.col("slot").between(low % DAY_MS // SLOT_MS, high % DAY_MS // SLOT_MS))
        alike = ["write", "stream_hash"]  # a day has one write
        rows = values.drop("slot", *alike).join(series.drop("mint", "maxt", *alike), ["day", "series_id"]).drop("day", "series_id")
        external = self.streams().get(stream, {}) if external is None else external
        return Storage(rows, external=external, series_rows=series.drop(*keys), unique=True, **options)

    def info(self) -> DataFrame:
        """stream_hash, external_labels, mint, maxt of the visible blocks."""
        times = self.discover().groupBy("stream_hash").agg(F.min("mint").alias("mint"), F.max("maxt").alias("maxt"))
        return times.join(self._read("streams", STREAMS).distinct(), "stream_hash").select("stream_hash", "external_labels", "mint", "maxt").orderBy("stream_hash")
