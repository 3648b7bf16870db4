"""Token ids as Parquet list columns in ascending document order, with selective reads.

Layout of a folder: columns doc_id, part (number of the file in order), local_start (ids before the document in its
file), n_tokens (with the end id), ids (list of int). `ids` is dictionary-encoded, the other columns delta-encoded; row
groups and pages are of controlled size and Parquet's page index lets a reader fetch single documents or metadata alone.

Nulls: a null text counts as empty (the end id alone); null doc_ids come first. Rows with equal doc_id are ordered by
the text's hash, then text, and may lie in several files; equal rows are written each. A text of any length is one list.
An empty table makes an empty folder of files. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

#: Different words of a slice are looked up once, so larger slices need fewer lookups; they go less often to a cache, which is small.
SLICE_BYTES, CACHED = 1 << 22, 100_000
SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_mb: int = 32, page_kb: int = 64) -> None:
    """Encode every text and write the folder `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, CACHED)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, texts in common.slices(batch, most=SLICE_BYTES):
                encoded = encoder.encode(texts)
                ends = np.array([end_id], encoder.dtype).tobytes()
                ids = np.frombuffer(ends.join(encoded) + ends, encoder.dtype).astype(np.int32)
                sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // encoder.dtype.itemsize + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(texts), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                start += int(offsets[-1])

    h = F.xxhash64("text")  # so that many rows of one doc_id, or of none, are no single range
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", h).sortWithinPartitions("doc_id", h, "text")
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "1000",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
    }
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens without reading any ids."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    table = spark.createDataFrame(sorted(bases(spark, path).items()), "part int, base bigint")
    return rows.join(F.broadcast(table), "part").select("doc_id", (F.col("local_start") + F.col("base")).alias("start"), "n_tokens")


def bases(spark: SparkSession, path: str) -> dict[int, int]:
    """ids before each file; there is one entry a file."""
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, start = {}, 0
    for part, n in sorted(tuple(x) for x in totals):
        out[part] = start
        start += n
    return out


def tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id and ids of the documents with ids from `first` to `last`; page and row-group statistics skip the rest."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "ids")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids, all as read from the files."""
    before = bases(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, local, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
            base = np.array([before[p] for p in part.tolist()], np.int64)
            lists = batch.column(4)
            ids, cuts = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B"), lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base + local), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
