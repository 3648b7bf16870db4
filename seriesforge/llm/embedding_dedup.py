"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where they leave doubt.

Equal vectors form a class, and one row of each class is compared. A normalised vector u is stored as scale * q with
int8 q, and its quantisation error e = |u - scale * q| is known exactly. For two vectors the product of the quantised
ones differs from the cosine by at most e1 + (1 + e1) * e2. Pairs whose bound clears the threshold are linked, pairs
whose bound stays below are not, the others are computed in double precision. The products run as float32 matrix products of
whole numbers below 2**24, which are exact. Classes are dealt into blocks by hash, of at most `block` rows and so many
that the pairs of blocks are several times the cluster's tasks; every pair of blocks is one group with at most two
blocks of rows, which returns each row's number of links and its local component, never the pairs. Each vector travels
once for every block, in the table's own type.

Vectors may be of any length, all of one block in memory. Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component. Vectors of different length never link. Rows that repeat a vec_id are vectors of their own; with equal
vectors they link. A null vec_id is kept and is no component's smallest id unless it has no other. Empty tables give no
rows. Further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .components import roots

#: Dimensions whose int8 products sum to less than 2**24.
EXACT = 1040


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the normalised rows of v (double)."""
    u = v / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(u - scale[:, None] * q, axis=1) + 1e-12


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int8 matrices."""
    parts = [a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T for i in range(0, a.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def block_links(v: np.ndarray, weight: np.ndarray, split: int, threshold: float, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows before `split` with those behind it or, if nothing is behind, among themselves.

    Returns the number of links of each row, counting `weight`, and the smallest row of its component.
    """
    q, scale, error = quantised(v)
    count, label = np.zeros(len(v), np.int64), np.arange(len(v))
    within = split == len(v)
    for a0 in range(0, split, tile):
        a1 = min(a0 + tile, split)
        for b0 in range(a0 if within else split, len(v), tile):
            b1 = min(b0 + tile, len(v))
            near = product(q[a0:a1], q[b0:b1])
            near *= scale[None, b0:b1].astype(near.dtype)
            # what the largest error of the columns leaves below the threshold is looked at no further; 1e-6 covers float32 scales
            most = error[a0:a1] + (1 + error[a0:a1]) * error[b0:b1].max() + 1e-6
            least = (threshold - most) / scale[a0:a1]
            i, j = np.nonzero(near >= (least - 1e-6 * np.abs(least)).astype(near.dtype)[:, None])
            if not len(i):
                continue
            x, y = a0 + i, b0 + j
            slack = error[x] + (1 + error[x]) * error[y] + 1e-6
            bound = near[i, j] * scale[x]
            link = np.zeros(near.shape, bool)
            link[i, j] = sure = bound - slack >= threshold
            doubt = (bound + slack >= threshold) & ~sure
            i, j = i[doubt], j[doubt]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                hit = cosines(v[a0 + x], v[b0 + y]) >= threshold
                link[x[hit], y[hit]] = True
            if within and a0 == b0:
                link = np.triu(link, 1)
            if not link.any():
                continue
            count[a0:a1] += link @ weight[b0:b1]
            count[b0:b1] += weight[a0:a1] @ link
            while True:  # every row and column joins its first link into another component
                apart = link & (label[a0:a1, None] != label[None, b0:b1])
                rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                if not len(rows):
                    break
                x = np.concatenate([label[a0 + rows], label[b0 + columns]])
                y = np.concatenate([label[b0 + apart[rows].argmax(axis=1)], label[a0 + apart[:, columns].argmax(axis=0)]])
                ids, root = roots(x, y)
                to = np.arange(len(v))
                to[ids] = root
                label = to[label]
    return count, label


def dealt(rows: int, tasks: int, block: int, least: int = 256) -> int:
    """Number of blocks: at most `block` rows in each and, unless they get fewer than `least`, four pairs of blocks a task."""
    wanted = int(np.ceil(np.sqrt(8 * tasks)))
    return max(1, -(-rows // block), min(wanted, rows // least))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, block: int = 8192) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    narrow = dict(embeddings.dtypes)["embedding"] == "array<float>"
    vector = F.col("embedding").cast("array<double>")
    valid = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0.0), F.lit(False))
    rows = embeddings.select("vec_id", vector.alias("embedding"), F.coalesce(valid, F.lit(False)).alias("valid"))
    one = rows.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    one = common.staged(one.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    blocks = dealt(one.count(), embeddings.sparkSession.sparkContext.defaultParallelism, block)
    own = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    pair = one.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    pair = pair.select(F.size("embedding").alias("dim"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "uid", "m", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "ascending"), ("uid", "ascending")]).combine_chunks()
        own, uid, m = (table.column(x).to_numpy() for x in ("own", "uid", "m"))
        v = table.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(len(uid), -1)
        split = int(np.searchsorted(own, own[0], "right"))
        if split == len(uid) and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            split = 0  # one of the two blocks has no vector of this length
        count, label = block_links(v, m, split, threshold)
        some = (count > 0) | (label != np.arange(len(uid)))
        return pa.table({"uid": uid[some], "n": count[some], "root": uid[label[some]]})

    found = common.staged(pair.groupBy("dim", "i", "j").applyInArrow(compare, "uid bigint, n bigint, root bigint"), "vector-links")
    root = components.connected(found.select("uid", "root"))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    one = one.join(counts, "uid", "left").join(root, one["uid"] == root["id"], "left")
    one = common.staged(one.select("embedding", "first", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")), "vector-roots")
    least = one.groupBy("root").agg(F.min("first").alias("least"))
    known = one.join(least, "root").select(F.col("embedding").alias("e"), F.col("n_links").alias("n"), "least")
    joined = rows.where("valid").join(known, F.col("embedding") == F.col("e")).select("vec_id", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
