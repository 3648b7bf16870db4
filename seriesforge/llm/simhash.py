"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word
shingles. Candidates: the bits are cut into segments of 22, 21 and 21, each padded to a 23-bit word of the perfect
binary Golay code. The keys of a word are the 12-bit indices of all codewords within distance 4 of it, one or six. Two
words at distance 2 or less have a word between them at distance 1 from both, whose codeword is within 3 of it: they
share a key. With 4 differing bits in all, at most one segment has 3 or more, so the two others share a key each, and
every pair of segments gives the 24-bit keys of its two parts. Fingerprints that share a key are verified by their
Hamming distance. Only distinct fingerprints are keyed; keys with more than `tile` fingerprints are cut into tiles whose
pairs are verified as separate groups, and each group returns its components as stars, not its pairs.

Nulls: a null text counts as empty; texts without words have fingerprint zero and link like any other. Rows with a null
doc_id get the smallest doc_id of their component, null if it has none. Repeated rows are returned each. A text of
any length is read whole, by one task. An empty table gives no rows. Only doc_id and text are read by fingerprints() and near_duplicates(). deduplicated() keeps one row of
each component, whether or not ids are null or occur elsewhere, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from .components import roots

SEGMENTS = (22, 21, 21)
_GENERATOR = 0b110001110101  # of the binary Golay code of length 23


def fingerprint(text: bytes, width: int = 4) -> int:
    """Of one UTF-8 text, unsigned."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - width].tolist()]
        hashes = [xxhash.xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and other long columns of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                fp = np.array([fingerprint(x, width) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *part.columns[2:]], ["doc_id", "fp", *others])

    return docs.select("doc_id", "text", *others).mapInArrow(run, ", ".join(f"{x} bigint" for x in ("doc_id", "fp", *others)))


def _remainder(x: np.ndarray) -> np.ndarray:
    """Of 23-bit words modulo the generator: the syndrome."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, _GENERATOR << (bit - 11), 0)
    return x


def _errors() -> np.ndarray:
    """For each syndrome, its error patterns of weight 4 at most: one or six, padded with -1."""
    patterns = np.array([sum(1 << b for b in some) for n in range(5) for some in combinations(range(23), n)])
    out = np.full((1 << 11, 6), -1)
    used = np.zeros(1 << 11, int)
    for pattern, syndrome in zip(patterns.tolist(), _remainder(patterns).tolist(), strict=True):
        out[syndrome, used[syndrome]] = pattern
        used[syndrome] += 1
    return out


_tables: list[np.ndarray] = []


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords within distance 4 of each word; -1 where there are fewer than six."""
    if not _tables:
        _tables.append(_errors())
    errors = _tables[0][_remainder(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): (key, row) for every pair of segments and of their codewords."""
    parts, shift = [], 0
    for n in SEGMENTS:
        parts.append(codeword_keys((fp >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int64)))
        shift += n
    keys, rows = [], []
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        both = (parts[a][:, :, None] << 12 | parts[b][:, None, :]) | number << 24
        row, i, j = np.nonzero((parts[a][:, :, None] >= 0) & (parts[b][:, None, :] >= 0))
        keys.append(both[row, i, j])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def linked(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all components of one group of distinct fingerprints; each step looks at those not yet reached."""
    a, b = [], []
    left = fp.copy()
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                front += found.tolist()
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def verified(batches: Iterator[pa.RecordBatch], bits: int, short: int = 48) -> Iterator[pa.RecordBatch]:
    """Rows (group, fp) sorted by group: links within groups, as stars. Short groups are compared all at once."""

    def links(group: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        for k in np.flatnonzero(size > short).tolist():
            yield linked(np.unique(fp[first[k] : first[k] + size[k]]), bits)
        some = np.repeat(size <= short, size)
        group, fp = group[some], fp[some]
        for d in range(1, int(size[size <= short].max(initial=1))):
            near = (group[d:] == group[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= bits)
            if near.any():
                yield fp[:-d][near], fp[d:][near]

    def runs() -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            if len(rows):
                held.append(rows)
            if held and held[0][0, 0] != held[-1][-1, 0]:
                rows = np.concatenate(held)
                cut = np.searchsorted(rows[:, 0], rows[-1, 0])
                held = [rows[cut:]]
                yield from pairs(rows[:cut])
        if held:
            yield from pairs(np.concatenate(held))

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in links(rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    yield from components.stars(runs())


def links(distinct: DataFrame, bits: int = 4, tile: int = 2048) -> DataFrame:
    """Links (a, b) that connect every two fingerprints of `distinct` (column fp) with at most `bits` differing bits."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp = batch.column(0).to_numpy()[i : i + 4096]
                keys, row = fuzzy_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[row])], ["key", "fp"])

    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fingerprint makes some 85 rows
    keyed = distinct.select("fp").repartition(tasks, "fp").mapInArrow(key, "key bigint, fp bigint")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    crowded = common.staged(crowded.select("key", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "crowded")
    # a group is a key, or a pair of tiles of a crowded key
    t = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("bigint")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1).cast("array<bigint>"))
    if crowded.isEmpty():
        grouped = keyed.select(F.col("key").alias("grp"), "fp")
    else:
        tiled = keyed.join(crowded, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        tiled = tiled.select("key", "fp", t.alias("t"), other.alias("o"))
        grouped = tiled.select((F.least("t", "o") * (1 << 45) + F.greatest("t", "o") * (1 << 27) + F.col("key")).alias("grp"), "fp")
    ordered = grouped.repartition("grp").sortWithinPartitions("grp")
    return ordered.mapInArrow(lambda b: verified(b, bits), "a bigint, b bigint")


def classes(prints: DataFrame, bits: int = 4) -> DataFrame:
    """One row per distinct fingerprint of `prints` (doc_id, fp): fp, root of its component, component_id (smallest doc_id reachable)."""
    distinct = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    root = components.connected(links(distinct, bits))
    rooted = distinct.join(root, distinct["fp"] == root["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = common.staged(rooted, "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = common.staged(fingerprints(docs, width), "prints")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes(prints, bits), "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, bits: int = 4, width: int = 4) -> DataFrame:
    """One row of each component: the one with the smallest doc_id, null last, all columns as they are.

    Of different texts under this doc_id the one with the smallest hash is kept, of equal texts one row. An id whose
    texts represent several components is kept once for each of them.
    """
    prints = common.staged(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), width, ("hash",)), "prints")
    found = prints.join(classes(prints, bits).select("fp", "root"), "fp").groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "hash")
    keep = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "hash", "n"), order).alias("kept"))
    names = [_fresh(x, docs.columns) for x in ("keep_root", "keep_id", "keep_hash", "keep_n")]
    root, i, h, n = names
    keep = common.staged(keep.select("root", "kept.doc_id", "kept.hash", "kept.n").toDF(*names), "kept")
    rows = docs.join(keep, docs["doc_id"].eqNullSafe(keep[i]) & (F.xxhash64(docs["text"]) == keep[h]))
    single = rows.where(F.col(n) == 1).select(*(docs[x] for x in docs.columns))
    if keep.where(F.col(n) > 1).isEmpty():
        return single
    # equal texts under one id: tasks choose among their rows first
    mixed = F.xxhash64(*(docs[c] for c, kind in docs.dtypes if "map<" not in kind))
    whole = F.struct(*(docs[x] for x in docs.columns))
    one = rows.where(F.col(n) > 1).groupBy(root).agg(F.min_by(whole, mixed).alias("kept"))
    return single.unionByName(one.select("kept.*"))


def _fresh(name: str, used: list[str]) -> str:
    while name in used:
        name += "_"
    return name
