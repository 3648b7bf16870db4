import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seriesforge.functions.matchers import Matcher
from seriesforge.model import DAY_MS, Grid, Interval, QueryError, days, series_id
from seriesforge.plans.compiler import compile_query
from seriesforge.sources.store import Source, Store, plan, stream_hash, vectored_ranges
from seriesforge.sources.landing import Landed, convert_landed, eligible, streams
from seriesforge.streaming import ingest

from .load import samples

D = date(1970, 1, 1)


def day(n):
    return D + timedelta(days=n)


def source(name, a, b):
    return Source(name, int(a * DAY_MS), int(b * DAY_MS))


def test_days_and_intervals():
    assert days(0, DAY_MS) == [day(0)]
    assert days(0, DAY_MS + 1) == [day(0), day(1)]
    assert Interval(0, 5).intersection(Interval(5, 9)) == Interval(5, 5)
    assert not Interval(0, 5).intersects(Interval(6, 9))


def test_plan():
    a, b = source("a", 0, 2), source("b", 2, 3.5)
    assert [d for d, _ in plan([a, b], [], day(9))] == [day(2), day(1), day(0)]  # day 3 is not whole
    assert plan([a, b], [day(1)], day(2)) == [(day(0), [a])]
    assert [d for d, _ in plan([a, b], [], day(9), max_days=1)] == [day(2)]
    assert [d for d, _ in plan([a], [], day(9), max_days=1)] == [day(1), day(0)]  # needs no further source
    assert plan([a], [day(0), day(1)], day(9)) == []


def test_ranges():
    assert vectored_ranges([(0, 5), (7, 9), (100, 110)], 50, 3) == [(0, 9), (100, 110)]
    assert vectored_ranges([(0, 5), (6, 60)], 50, 3) == [(0, 5), (6, 60)]
    assert vectored_ranges([], 1, 1) == []


def test_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    raw = samples(spark, 'm{a="1",b=""} 0+1x8\nm{a="2"} 0+2x8', 8 * 3600)
    with pytest.raises(QueryError):
        store.convert(raw.limit(0), {"e": "x"}, [])
    assert store.convert(raw.unionByName(raw), {"e": "x"}, ["one"]) == [day(0), day(1), day(2)]
    stream = stream_hash(spark, {"e": "x"})
    s = store.open(stream, 0, 3 * DAY_MS)
    assert s.select([]).count() == 18
    assert {r["l_e"] for r in s.select([Matcher("a", "=", "2")]).collect()} == {"x"}
    assert [r["value"] for r in compile_query(s, "sum(m)", Grid.instant(DAY_MS)).df.collect()] == [9.0]
    assert store.discover().count() == 3 and store.discover(Interval(0, DAY_MS - 1)).count() == 2
    assert store.info().first()["maxt"] == 8 * 8 * 3_600_000
    # retention: mark, then delete after the delay
    now = 3 * DAY_MS
    assert store.mark_expired(now, 2 * DAY_MS) == 1 and store.mark_expired(now, 2 * DAY_MS) == 0
    assert store.discover().count() == 2
    assert store.delete_marked(now) == [] and store.delete_marked(now + DAY_MS) == [day(0)]
    assert store.open(stream, 0, 3 * DAY_MS).select([]).count() == 12


def test_streaming(spark, tmp_path):
    raw = samples(spark, 'm{a="1"} 0+1x8', 8 * 3600)
    raw.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    schema = raw.schema.simpleString()[7:-1]
    stream = ingest.landing(spark, str(tmp_path / "in"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema)) if schema else None
    ingest.ingest(stream, store, {}, str(tmp_path / "check"), before=day(2)).awaitTermination(120)
    assert store.open(0, 0, 9 * DAY_MS).select([]).count() == 6
    agg = ingest.windowed(ingest.landing(spark, str(tmp_path / "in"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema)), "1 day")
    q = agg.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["start_ms"], r["n"]) for r in spark.table("daily").collect()) == [(0, 3), (DAY_MS, 3), (2 * DAY_MS, 3)]


def land(spark, path, *lines):
    samples(spark, "\n".join(lines), 8 * 3600).coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, path):
    schema = spark.read.parquet(str(path)).schema
    return ingest.landing(spark, str(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))


def test_held_back_samples_wait(spark, tmp_path):
    land(spark, tmp_path / "in", 'm{a="1"} 0+1x8')
    store = Store(spark, str(tmp_path / "store"))

    def run(before=None):
        ingest.ingest(stream_of(spark, tmp_path / "in"), store, {}, str(tmp_path / "check"), before).awaitTermination(120)
        return store.open(0, 0, 9 * DAY_MS).select([]).count()

    assert run(day(1)) == 3 and ingest.pending(store).count() == 6
    assert run(day(2)) == 6 and ingest.pending(store).count() == 3
    assert run(day(2)) == 6
    assert run() == 9 and store.discover().count() == 3


def test_a_late_batch_is_merged(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first, late = samples(spark, 'm{a="1"} 1', 1).withColumn("ts_ms", F.lit(1000).cast("bigint")), samples(spark, 'm{a="1",b="2"} 5\nm{a="1"} 3', 1).withColumn("ts_ms", F.lit(3000).cast("bigint"))
    store.convert(first, {}, ["one"])
    store.convert(late, {}, ["two"])
    seen = lambda low, high: sorted((r["ts_ms"], r["value"], r["l_b"]) for r in store.open(0, low, high).select([]).collect())
    assert seen(0, 2000) == [(1000, 1.0, None)]
    want = [(1000, 1.0, None), (3000, 3.0, None), (3000, 5.0, "2")]
    assert seen(0, 9000) == want
    store.convert(late, {}, ["two"])  # tried again
    assert seen(0, 9000) == want
    block = store.blocks().first()
    assert (block["mint"], block["maxt"], block["samples"], block["series"], block["sources"]) == (1000, 3000, 3, 2, ["one", "two"])
    later = (block["written"] if "written" in block else 0) or 10**14
    assert store.sweep(later) == 2 and store.sweep(later) == 0 and seen(0, 9000) == want


def test_metadata_comes_from_series(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.convert(samples(spark, 'm{a="1",e="own"} 0+1x8\nn{a="2"} 1', 8 * 3600), {"e": "x"}, ["one"])
    s = store.open(stream_hash(spark, {"e": "x"}), 0, 9 * DAY_MS)
    assert "samples" not in "".join(s.series([]).inputFiles()) and "/series/" in "".join(s.series([]).inputFiles())
    assert {r["l_e"] for r in s.series([]).collect()} == {"x"} and s.series([]).count() == 2
    assert [r[0] for r in s.label_values("a", [Matcher("__name__", "=", "n")]).collect()] == ["2"]
    assert s.series([], low=DAY_MS).count() == 1
    # series that become equal, or values that are replaced, are told
    assert s.conflicts([]) is False and s.label_values("e").first()[0] == "x" and s.warnings.messages
    other = store.open(stream_hash(spark, {"e": "x"}), 0, 9 * DAY_MS, external={"e": "y", "z": "1"})
    assert {(r["l_e"], r["l_z"]) for r in other.select([]).collect()} == {("y", "1")}
    # without hidden labels stored samples are not merged again
    own = store.open(stream_hash(spark, {"e": "x"}), 0, DAY_MS, external={})
    assert "Aggregate" not in own.select([])._jdf.queryExecution().toString()
    assert own.select([]).count() == 5 and store.open(stream_hash(spark, {"e": "x"}), 9 * 3_600_000, 20 * 3_600_000).select([]).count() == 1


def test_series_ids_do_not_collide(spark):
    rows = [("x\x1eb\x1fy", None), ("x", "y"), ("x,b=1:y", None)]
    df = spark.createDataFrame(rows, "l_a string, l_b string").select(series_id(["a", "b"]).alias("i"))
    assert df.distinct().count() == 3


def test_landed_blocks(spark, tmp_path):
    h = 3_600_000
    found = [
        Landed("a", 0, DAY_MS, {"e": "x"}), Landed("b", DAY_MS, 2 * DAY_MS, {"e": "x"}), Landed("c", 0, DAY_MS, {"e": "y"}), Landed("d", 0, DAY_MS, {"e": "x"}, resolution_ms=300_000),
        Landed("e", 0, DAY_MS, {"e": "x"}, chunks=0), Landed("f", 0, DAY_MS, {"e": "x"}, marked=True), Landed("g", 0, DAY_MS, {"e": "x"}, complete=False), Landed("h", 0, DAY_MS, {"e": "x"}, uploaded_ms=99),
    ]
    assert [b.name for b in eligible(found, now_ms=100, min_age_ms=50)] == ["a", "b", "c"]
    assert [b.name for b in eligible(found[:3], (Matcher("e", "=", "y"),))] == ["c"]
    assert [(k, [b.name for b in v]) for k, v in streams(found[:3])] == [({"e": "x"}, ["a", "b"]), ({"e": "y"}, ["c"])]
    store, loads = Store(spark, str(tmp_path)), []

    def load(name):
        loads.append(name)
        start = {"a": 0, "b": 3, "c": 0}[name]
        return samples(spark, 'm{a="1"} 0+1x2', 8 * 3600).withColumn("ts_ms", F.col("ts_ms") + start * 8 * h)

    done = convert_landed(store, found[:3], load, day(9))
    assert sorted(d for _, d in done) == [day(0), day(0), day(1)] and store.discover().count() == 3
    assert convert_landed(store, found[:3], load, day(9)) == []


def test_periodic_jobs(spark):
    stop, runs = threading.Event(), []

    def job():
        runs.append(1)
        if len(runs) == 3:
            raise ValueError("done")

    thread = ingest.periodically(job, 0.01, stop)
    thread.join(10)
    assert len(runs) == 3 and isinstance(thread.error, ValueError) and stop.is_set()


def shuffled(spark):
    """Records written to shuffles so far."""
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_late_batch_is_shuffled_once(spark, tmp_path, monkeypatch):
    """Stored samples meet late ones in one shuffle, without a join or a second one for their order."""
    monkeypatch.setattr("seriesforge.sources.store.ROWS_A_TASK", 1000, raising=False)
    store = Store(spark, str(tmp_path))
    rows = spark.range(6000).select((F.col("id") * 20_000).alias("ts_ms"), F.col("id").cast("double").alias("value"), F.lit("m").alias("l___name__"), (F.col("id") % 20).cast("string").alias("l_a"), F.col("id"))
    store.convert(rows.where("id % 2 = 0"), {}, ["one"])
    before = shuffled(spark)
    assert store.convert(rows.where("id % 3 > 0"), {}, ["two"]) == [day(0), day(1)]
    assert shuffled(spark) - before < 8000  # 3000 are stored, 4000 come
    got = store.open(0, 0, 9 * DAY_MS).select([])
    assert sorted((r["ts_ms"], r["value"], r["l_a"]) for r in got.collect()) == [(i * 20_000, float(i), str(i % 20)) for i in range(6000) if i % 2 == 0 or i % 3]
    # files are sorted, and none of a day takes series of another one's
    last = store.blocks().where("day = '1970-01-01'").first()
    files = sorted((tmp_path / "samples" / f"write={last['write']}" / "stream_hash=0" / "day=1970-01-01").glob("*.parquet"))
    each = [[(r["series_id"], r["ts_ms"]) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(each) > 1 and all(x == sorted(x) for x in each) and sum(map(len, each)) == last["samples"] and last["series"] == 20
    assert sum(len({s for s, _ in x}) for x in each) == 20
