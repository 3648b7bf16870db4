"""Structured Streaming on samples: ingest of whole days, and windowed aggregation with a watermark."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import day_start, label, label_columns
from ..sources.store import Store


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples that arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def pending(store: Store, name: str = "pending") -> DataFrame | None:
    """Samples that earlier runs held back."""
    return store._read(name)


def release(store: Store, external: dict[str, str], before: date | None = None, name: str = "pending") -> None:
    """Convert samples that were held back and are due now; the others are written anew before the old ones go.

    Tried again after a failure, it converts the same samples again, which the store merges.
    """
    rows = pending(store, name)
    if rows is None:
        return
    parts = sorted(r[0] for r in rows.select("part").distinct().collect())
    rows = rows.drop("part")
    due = rows if before is None else rows.where(F.col("ts_ms") < day_start(before))
    if due.isEmpty():
        return
    store.convert(due, external, ["held-back"])
    if before is not None:
        rest = rows.where(F.col("ts_ms") >= day_start(before))
        if not rest.isEmpty():
            rest.write.mode("overwrite").parquet(f"{store.root}/{name}/part=r{uuid.uuid4().hex}")
    for part in parts:
        path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/{name}/part={part}")
        path.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest(samples: DataFrame, store: Store, external: dict[str, str], checkpoint: str, before: date | None = None, name: str = "pending") -> StreamingQuery:
    """Convert what has arrived, then stop; samples of days from `before` on wait in the store for a later run.

    A later run begins with what waits. Batches that are tried again overwrite what they held back, and the store merges
    what they converted.
    """
    release(store, external, before, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            rows = batch
            if before is not None:
                rows, held = batch.where(F.col("ts_ms") < day_start(before)), batch.where(F.col("ts_ms") >= day_start(before))
                if not held.isEmpty():
                    held.write.mode("overwrite").parquet(f"{store.root}/{name}/part=b{number}")
            if not rows.isEmpty():
                store.convert(rows, external, [f"batch-{number}"])
        finally:
            batch.unpersist()

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def periodically(job: Callable[[], object], every_s: float, stop: threading.Event) -> threading.Thread:
    """Run discovery, conversion or retention again and again until `stop`; a failure is kept and ends the loop."""

    def loop() -> None:
        while not stop.is_set():
            try:
                job()
            except Exception as e:  # noqa: BLE001  handed to whoever joins the thread
                thread.error = e
                stop.set()
            stop.wait(every_s)

    thread = threading.Thread(target=loop, daemon=True)
    thread.error = None
    thread.start()
    return thread


def windowed(samples: DataFrame, window: str, late: str = "48 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, least and greatest value per window and labels; samples later than `late` are left out."""
    by = by or tuple(label_columns(samples.columns))
    timed = samples.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window), *(label(x) for x in by)).agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), *(label(x) for x in by), "n", "sum", "least", "greatest")
