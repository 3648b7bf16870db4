"""Connected components of links between long ids, as DataFrames all the way.

Ids with many links are split: links of an id are dealt out by the hash of their other end into `SALTS` parts, whose
minima are combined and sent back to the parts, so no join brings all links of an id together.

Nulls: links with a null end are left out. Repeated links and links of an id to itself are taken; an empty table gives no
rows. Loops that do not end in `rounds` rounds raise an error, and they end only when a round leaves the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 16


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur in links (a[i], b[i]), and the smallest id that each one reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while not np.array_equal(hooked, hooked[hooked]):
            hooked = hooked[hooked]
        hooked = hooked[label]
        if np.array_equal(hooked, label):
            return ids, ids[label]
        label = hooked


def stars(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Links with the same components: each id to the smallest that it reaches within the task, `most` links at a time."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        ids, root = roots(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        some = ids != root
        waiting[:] = [(ids[some], root[some])]
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in waiting) > most and len(out().column(0)) > most // 2:
            yield out()
            waiting.clear()
    if waiting:
        yield out()


def with_least(links: DataFrame) -> DataFrame:
    """`links` (a, b) with m, the smallest b of all links of a."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    links = links.withColumn("salt", salt)
    parts = links.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))  # SALTS rows an id at most
    return links.join(least.select("a", F.explode("salts").alias("salt"), "m"), ["a", "salt"]).select("a", "b", "m")


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """id and root, the smallest id of its component, for every id in `links` (two long columns); links to itself count.

    Rounds of large and small stars: every id's larger neighbours link to the smallest one that it knows, then every id
    and its smaller neighbours do. Each round ends in a written table.
    """
    given = common.staged(links.toDF("a", "b").where("a is not null and b is not null"), "given-links")
    now = common.staged(given.where("a <> b").mapInArrow(stars, "a bigint, b bigint").distinct(), "links")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = large.where("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        known = with_least(down)
        small = known.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(known.where("b = m").select("a", "b"))
        following = common.staged(small.mapInArrow(stars, "a bigint, b bigint").distinct(), "links")
        before, mark = mark, _mark(following)
        done = mark == before and following.join(now, ["a", "b"], "left_anti").isEmpty()  # both are free of repeats
        common.discard(now)
        now = following
        if done:
            break
    else:
        raise ArithmeticError(f"components are not found after {rounds} rounds")
    linked = now.groupBy("a").agg(F.min("b").alias("b"))
    nodes = linked.unionByName(now.select(F.col("b").alias("a"), "b")).unionByName(given.where("a = b").select("a", "b"))
    return nodes.groupBy("a").agg(F.min("b").alias("b")).toDF("id", "root")


def _mark(links: DataFrame) -> tuple:
    wide = F.xxhash64("a", "b").cast("decimal(38, 0)")
    return tuple(links.agg(F.count("*"), F.sum(wide)).first())
