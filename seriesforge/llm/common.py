"""Shared helpers: staging in the cluster's shared folder, Arrow batches, held-out folds, label samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

#: Bytes of text that the numpy kernels take at once; a longer single text forms its own slice.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or an own one where it is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seriesforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and reread it: lineage ends there, and lost executors lose nothing."""
    path = staging_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what staged() wrote."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Give freed memory back to the system, which else stays with workers that wait for their next task."""
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about `most` bytes of text each, one row at least, and their texts."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            part = batch.slice(first, i - first)
            yield part, texts(column.slice(first, i - first))
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first), texts(column.slice(first))
    trim()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep: Column | None = None) -> DataFrame:
    """At most `most` labelled documents (doc_id, text, label), the first by a hash of the id.

    Only rows of `labels` for which `keep` holds are looked at. Ids labelled twice take the majority, ties are 1; null
    labels and ids are left out. A document id that occurs several times is taken once.
    """
    chosen = labels.select("doc_id", F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    if keep is not None:
        chosen = chosen.where(keep)
    chosen = chosen.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` rows bound the broadcast
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
