"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a rest of pieces of at most `piece` ids. Pieces are dealt into groups
that fill about `windows` sequences; in each group, partial partitions are merged by differencing, those with the
largest imbalance first and largest sums against smallest, into near-equal windows. If a window exceeds the capacity, the group takes one
window more. The number of groups follows the number of ids, so a group stays small at every size.

Nulls: a null text counts as empty (the end id alone); a null doc_id is kept. Repeated rows are packed each. An empty
table gives no pieces. Texts of any length are cut. Only doc_id and text are read, further columns never clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def differenced(lengths: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Sum and items of each window; items are indices of `lengths`.

    A partial partition lists (sum, tree of items) by falling sum and leaves out empty windows.
    """
    heap = [(-x, i, [(x, i)]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone = max(0, windows - len(b))
        both = [(x + y, (s, t)) for (x, s), (y, t) in zip(a[alone:], b[: windows - 1 - len(a) if len(a) < windows else None : -1], strict=False)] if len(a) > alone else []
        merged = a[:alone] + both + b[: max(0, windows - len(a))]
        merged.sort(key=lambda p: -p[0])
        imbalance = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-imbalance, number, merged))
        number += 1
    out = []
    for total, tree in heap[0][2] if heap else []:
        items, open_ = [], [tree]
        while open_:
            x = open_.pop()
            if isinstance(x, tuple):
                open_ += x
            else:
                items.append(x)
        out.append((total, sorted(items)))
    return out


def packed(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of items within the capacity, as few as differencing allows."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differenced(lengths, windows)
        if max((x for x, _ in found), default=0) <= capacity:
            return [items for _, items in found]
        windows += 1


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, piece: int = 1024) -> DataFrame:
    """Every document's pieces: full sequences first, then the rest in parts of at most `piece` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for rows, texts in common.slices(batch):
                columns: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, encoded in zip(rows.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids = np.append(np.frombuffer(encoded, encoder.dtype), end_id).astype("<u4")
                    n, full = len(ids), len(ids) // capacity * capacity
                    parts = -(-(n - full) // piece)
                    cuts = [*range(0, full, capacity), *(full + (n - full) * k // parts for k in range(parts)), n]
                    data = memoryview(ids).cast("B")
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        for c, v in zip(columns, (doc_id, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, piece: int = 1024, windows: int = 128) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = common.staged(pieces(docs, tokenizer, end_id, capacity, piece).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    total = cut.where(~full).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, total // (windows * capacity))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        length = group["length"].tolist()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k, items in enumerate(packed(length, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = k, at
                at += length[i]
        group["sequence_id"], group["offset"] = 2 * (group["grp"] * (1 << 24) + sequence), offset
        return group[[x.split()[0] for x in PACKED.split(", ")]]

    names = [x.split()[0] for x in PIECES.split(", ")]
    rest = cut.where(~full).withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    alone = cut.where(full).select(*names, (2 * F.col("uid") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return rest.groupBy("grp").applyInPandas(place, PACKED).unionByName(alone)
