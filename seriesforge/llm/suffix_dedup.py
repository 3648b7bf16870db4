"""Removal of repeated strings: every byte that a `width`-byte string covers which also starts earlier goes.

Each width-byte window of a text has one anchor, the leftmost least hash of its GRAM-byte substrings, so equal windows
have equal anchors at equal places. Windows that share an anchor form a segment of the text. Only segments whose anchor
occurs elsewhere can hold a repeated window:

1. Segments' hashes are brought together by anchor; tasks send one row for each different segment only. Of equal
   segments all but the first are removed whole.
2. First segments whose anchors occur in different segments fetch their texts and are dealt out by anchor into shards.
   External induced sorting orders a shard's suffixes with their common prefixes; of windows that agree in all
   bytes, all but the first are removed. Anchors with more than `crowd` different segments are dealt out by longer common
   parts of their windows, and if more than `crowd` segments share one of these, too, each window goes by its own bytes.
   So no task holds more of one anchor than `crowd` segments at a time.
3. Removed spans are merged for each document.

Order: smaller doc_id first (null last), then earlier start. Rows with equal doc_id and equal text are one document, with
equal doc_id the text's hash decides. Nulls: a null text is empty. Texts shorter than `width` stay whole, long ones are
read in pieces of PIECE bytes. `width` is from GRAM to 255. An empty table gives no rows. Segments' equality and anchors go
by 63 and 64 bits of hash. Only doc_id and text are read by spans(); without_repeats() keeps all columns as they are but the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .induced_sort import AT_ONCE, suffix_order
from .textstats import mix, powers, prefix_hash, span_hash

GRAM = 24
#: Symbols of a shard; one anchor's segments may exceed it, its queues then go to a scratch file.
SHARD = 8 << 20
PIECE = 4 << 20  # bytes of text whose anchors are found at once
KEPT_BITS = 40  # of a hash, to be compared when anchors are chosen; the other 24 are for places in a piece
BROADCAST_KEYS = 1_000_000  # longs
PARTS = 10  # windows of a crowded anchor are dealt out by their distance from it, so many distances at once


def segments(texts: list[bytes], width: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Of all texts: anchor hash, segment hash, text number, first window, anchor - first window, windows - 1.

    Texts are taken together up to `piece` bytes, a longer one in overlapping pieces, which may cut a segment in two.
    """
    out, some, size = [], [], 0

    def flush() -> None:
        if some:
            h, c, at, first, ahead, more = _segments([texts[k][a:b] for k, a, b in some], width)
            number, offset = (np.array(x, np.int64) for x in ([k for k, _, _ in some], [a for _, a, _ in some]))
            out.append((h, c, number[at], first + offset[at], ahead, more))
            some.clear()

    for k, text in enumerate(texts):
        for a in range(0, max(len(text) - width + 1, 0), piece):
            b = min(a + piece + width - 1, len(text))
            if size + b - a > piece + width:
                flush()
                size = 0
            some.append((k, a, b))
            size += b - a
    flush()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _segments(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n, span = len(buffer), width - GRAM + 1
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = prefix_hash(buffer)
    start = np.arange(n - GRAM + 1)
    _, inverse = powers(len(prefix))
    gram = (prefix[GRAM:] - prefix[: n - GRAM + 1]) * inverse[: n - GRAM + 1]
    bits = np.uint64(64 - KEPT_BITS)
    low = gram >> bits << bits | start.astype(np.uint64)  # the leftmost of equal ones is least
    step = 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    anchor = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)  # of the window at each position
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = start[: len(anchor)] + width <= ends[doc[: len(anchor)]]
    at = np.flatnonzero(whole)
    anchor, doc = anchor[at], doc[at]
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])[: len(at)]
    head = np.flatnonzero(fresh)
    more = np.diff(np.append(head, len(at))) - 1
    first, anchor, doc = at[head], anchor[head], doc[head]
    ahead = anchor - first
    content = mix(span_hash(prefix, first, first + more + width) + ahead.astype(np.uint64))
    return mix(gram[anchor]).view(np.int64), (content >> np.uint64(1)).view(np.int64), doc, first - (ends - sizes)[doc], ahead, more


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], start[1:] > reach[:-1]])[: len(start)]
    head = np.flatnonzero(fresh)
    return start[head], reach[np.append(head[1:], len(start)) - 1] if len(head) else reach[:0]


def _merged_by(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """merged() for each document at once; documents any longs."""
    ids, at = np.unique(doc, return_inverse=True)
    wide = int(end.max(initial=0)) + 2
    a, b = merged(at * wide + start, at * wide + end)
    return ids[a // wide], a % wide, b - a // wide * wide


def _found(batches: Iterator[pa.RecordBatch], width: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, oid, at): a first segment with at = start, distances packed; or a removed span with c = -1 - end, at = start."""

    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, c, oid, at = (np.concatenate([x.pop(0) for x in held]) for _ in range(4))
        held.clear()
        order = np.lexsort((at, oid, c, h))
        again = np.zeros(len(order), bool)
        for x in (h, c):  # sorted one after the other, in place
            x[:] = x[order]
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        dup, one = order[again], order[~again]
        del order
        first = at[dup] >> 16
        d, a, b = _merged_by(oid[dup], first, first + (at[dup] & 255) + width)
        rows = h[~again], c[~again], oid[one], at[one]
        del h, c, oid, at, again, dup, one, first
        common.trim()
        yield from _rows(rows)
        yield from _rows((d * 31, -1 - b, d, a))

    held: list[list[np.ndarray]] = []
    for batch in batches:
        for part, texts in common.slices(batch):
            h, c, doc, first, ahead, more = segments(texts, width)
            held.append([h, c, part.column(0).to_numpy()[doc], first << 16 | ahead << 8 | more])
        if sum(len(x[0]) for x in held) > most:
            yield from out(held)
    if held:
        yield from out(held)


def _rows(columns: tuple[np.ndarray, ...], names: tuple[str, ...] = ("h", "c", "oid", "at"), most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + most]) for x in columns], list(names))


def _groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches that end where the first column's value does or, of a value with over `most` rows, inside it (True)."""
    held: list[pa.RecordBatch] = []

    def out(cut: bool) -> Iterator[tuple[pa.RecordBatch, bool]]:
        for x in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield x, cut
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() != key[-1] or key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            held.append(batch.slice(0, cut))
            yield from out(False)
            batch = batch.slice(cut)
        held.append(batch)
        if sum(x.num_rows for x in held) > most:
            yield from out(True)
    if held:
        yield from out(False)


def _judged(batches: Iterator[pa.RecordBatch], width: int, crowd: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, c, oid, at): removed spans (h null, oid, start, end), and questions (h, oid, at, crowded).

    An anchor with over `most` rows is crowded from its first rows on, and all its first segments are questions.
    """
    last = None  # (h, c) where a batch ended inside an anchor
    for batch, cut in _groups(batches, most):
        h, c, oid, at = (batch.column(k).to_numpy() for k in range(4))
        large = np.zeros(len(h), bool)
        if last is not None:
            large |= h == last[0]
        if cut:
            large |= h == h[-1]
        spans = c < 0
        d, a, b = [oid[spans]], [at[spans]], [-1 - c[spans]]
        fresh_h = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        fresh = fresh_h | np.concatenate([[True], c[1:] != c[:-1]])[: len(h)]
        if last is not None:
            fresh[0] = last != (h[0], c[0])
        last = (h[-1], c[-1]) if cut else None
        again = ~fresh & ~spans
        first, more = at[again] >> 16, at[again] & 255
        d, a, b = _merged_by(*(np.concatenate(x) for x in ([*d, oid[again]], [*a, first], [*b, first + more + width])))
        for part in _rows((d, a, b), ("oid", "start", "end")):
            yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), *part.columns], ["h", "oid", "start", "end"])
        fresh &= ~spans
        group = np.cumsum(fresh_h) - 1
        kinds = np.bincount(group[fresh], minlength=group[-1] + 1 if len(group) else 0)
        ask = fresh & ((kinds[group] > 1) | large)
        yield from _rows((h[ask], oid[ask], at[ask], ((kinds[group[ask]] > crowd) | large[ask]).astype(np.int64)), ("h", "oid", "start", "end"))


def _fetched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (oid, text, asks): texts of the segments, (key, oid, first window, bytes, is the anchor crowded?)."""
    for batch in batches:
        for part, texts in common.slices(batch):
            keys, oids, firsts, bodies, crowded = [], [], [], [], []
            for oid, text, asks in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), strict=True):
                for ask in asks:
                    first, ahead, more = ask["start"] >> 16, ask["start"] >> 8 & 255, ask["start"] & 255
                    if not ask["end"]:
                        cuts = [(ask["h"], 0, more)]
                    else:  # windows at distances k * PARTS to k * PARTS + PARTS - 1 before the anchor share these bytes
                        cuts, anchor = [], first + ahead
                        for k in range((ahead - more) // PARTS, ahead // PARTS + 1):
                            shared = text[max(0, anchor - k * PARTS) : anchor - k * PARTS - PARTS + 1 + width]
                            key = int.from_bytes(hashlib.blake2b(shared + bytes([k]), digest_size=8, key=ask["h"].to_bytes(8, "little", signed=True)).digest(), "little", signed=True)
                            cuts.append((key, max(0, ahead - k * PARTS - PARTS + 1), min(more, ahead - k * PARTS)))
                    for key, a, b in cuts:
                        keys.append(key)
                        oids.append(oid)
                        firsts.append(first + a)
                        bodies.append(text[first + a : first + b + width])
                        crowded.append(ask["end"] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(oids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(bodies, pa.binary()), pa.array(crowded, pa.bool_())], ["key", "oid", "first", "body", "crowded"])


def repeated(oid: np.ndarray, first: np.ndarray, bodies: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Of one shard: spans (oid, start, end) of windows that equal an earlier one, by the order of its suffixes."""
    order = np.lexsort((first, oid))  # windows of a document belong to one segment each, so text order is window order
    bodies = [bodies[i] for i in order.tolist()]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.zeros(sizes.sum() + len(sizes), np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = np.frombuffer(b"".join(bodies), np.uint8)
    text += inside
    del bodies, inside
    window = np.ones(len(text), bool)
    for k in range(width):  # the last places of a segment begin no window
        window[begin + sizes - k] = False
    suffix, shared = suffix_order(text, width)
    keep = np.concatenate([window[suffix[i : i + AT_ONCE]] for i in range(0, len(suffix), AT_ONCE)] or [window])
    group = np.cumsum(shared < width, dtype=suffix.dtype)[keep]
    suffix = suffix[keep]
    if not len(suffix):
        return (np.zeros(0, np.int64),) * 3
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(suffix, head), np.diff(np.append(head, len(group))))
    later = suffix[suffix != earliest]
    segment = np.searchsorted(begin, later, "right") - 1
    start = first[order][segment] + later - begin[segment]
    return _merged_by(oid[order][segment], start, start + width)


def _sorted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, oid, first, body) sorted by key: shards of whole keys through the suffix order."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        columns = t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist()
        del t
        held.clear()
        spans = repeated(*columns, width)
        del columns
        common.trim()
        return _rows(spans, ("oid", "start", "end"))

    size = 0
    for batch, _ in _groups(batches, most=1 << 62):  # `crowd` segments a key at most
        if held and size + batch.column(3).nbytes > SHARD:
            yield from out()
            size = 0
        held.append(batch)
        size += batch.column(3).nbytes
    if held:
        yield from out()


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text (null: empty), oid: longs in the order of documents, equal for equal doc_id and text; are all different?"""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    unsure = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if unsure.isEmpty():
        return rows.withColumn("oid", F.col("doc_id")), True
    rows = rows.withColumn("th", F.xxhash64("text"))
    # ids that occur once keep their order: bucket counts of a range partitioning give each part its first number
    one = rows.select("doc_id", "th").distinct().repartitionByRange(F.col("doc_id").asc_nulls_last(), "th").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "th")
    one = common.staged(one.withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id()), "numbers")
    number = one.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("mono").alias("oid"))
    return rows.join(number, rows["doc_id"].eqNullSafe(number["d"]) & (rows["th"] == number["t"])).select("doc_id", "text", "oid"), False


def _windows(batches: Iterator[pa.RecordBatch], width: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of rows (key, oid, first, body): (oid, start, body) of the first of equal windows, and of others without body."""
    first_of: dict[bytes, tuple[int, int]] = {}

    def out(rows: list[tuple[int, int, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["oid", "start", "body"])

    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            _, oid, first, body = (x.to_pylist() for x in batch.slice(k, 4096).columns)
            later = []
            for o, f, t in zip(oid, first, body, strict=True):
                for i in range(len(t) - width + 1):
                    window, at = t[i : i + width], (o, f + i)
                    least = first_of.setdefault(window, at)
                    if least != at:
                        first_of[window] = min(least, at)
                        later.append((*max(least, at), None))
            yield out(later)
            if len(first_of) > most:
                yield out([(*at, window) for window, at in first_of.items()])
                first_of = {}
    yield out([(*at, window) for window, at in first_of.items()])


def removed(rows: DataFrame, width: int, crowd: int) -> DataFrame:
    """Spans (oid, start, end) to be removed, perhaps overlapping, of documents (oid, text), one row for each oid."""
    if not GRAM <= width < 256:
        raise ValueError(f"width must be from {GRAM} to 255")
    found = rows.select("oid", "text").mapInArrow(lambda b: _found(b, width), "h bigint, c bigint, oid bigint, at bigint")
    judged = found.repartition("h").sortWithinPartitions("h", "c", "oid", "at").mapInArrow(lambda b: _judged(b, width, crowd), "h bigint, oid bigint, start bigint, end bigint")
    judged = common.staged(judged, "judged")
    asked = judged.where("h is not null")

    asks = asked.groupBy("oid").agg(F.collect_list(F.struct("h", "start", "end")).alias("asks"))
    texts = rows.select("oid", "text").join(asks, "oid").select("oid", "text", "asks")
    # crowded or not, segments are fetched at once and kept, so that texts travel once to here, and once to their spans
    bodies = common.staged(texts.mapInArrow(lambda b: _fetched(b, width), "key bigint, oid bigint, first bigint, body binary, crowded boolean"), "segments", compression="zstd")

    def ordered(bodies: DataFrame) -> DataFrame:
        return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _sorted(b, width), "oid bigint, start bigint, end bigint")

    spans = judged.where("h is null").select("oid", "start", "end")
    parts, others = (bodies.where(x).drop("crowded") for x in ("crowded", "not crowded"))
    hot = common.staged(parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded-keys")
    number = hot.count()
    if not number:
        return spans.unionByName(ordered(bodies.drop("crowded")))
    hot = F.broadcast(hot) if number <= BROADCAST_KEYS else hot
    spans = spans.unionByName(ordered(others.unionByName(parts.join(hot, "key", "left_anti"))))
    windows = parts.join(hot, "key", "left_semi").mapInArrow(lambda b: _windows(b, width), "oid bigint, start bigint, body binary")
    windows = common.staged(windows, "crowded-windows")
    candidates = windows.where("body is not null")
    least = candidates.groupBy("body").agg(F.count("*").alias("n"), F.min(F.struct("oid", "start")).alias("least")).where("n > 1").drop("n")
    later = candidates.join(least, "body").where((F.col("oid") != F.col("least.oid")) | (F.col("start") != F.col("least.start")))
    later = later.select("oid", "start").unionByName(windows.where("body is null").select("oid", "start"))
    return spans.unionByName(later.select("oid", "start", (F.col("start") + width).alias("end")))


def with_spans(docs: DataFrame, width: int, crowd: int) -> DataFrame:
    """doc_id, text, oid and spans (array of start, end; null if there are none)."""
    rows, different = numbered(docs)
    one = rows if different else rows.dropDuplicates(["oid"])
    spans = removed(one, width, crowd).groupBy("oid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return rows.join(spans, "oid", "left").select("doc_id", "text", "spans")


def _runs(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array([(x["start"], x["end"]) for x in spans or []], np.int64).reshape(-1, 2)
    return merged(pairs[:, 0], pairs[:, 1])


def _left(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join([text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)])


def _checked(width: int) -> None:
    """Places are two bytes and common prefixes one."""
    if not GRAM <= width <= 255:
        raise ValueError(f"width must be from {GRAM} to 255, not {width}")


def spans(docs: DataFrame, width: int = 100, crowd: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    _checked(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                runs = [_runs(x) for x in part.column(2).to_pylist()]
                digests = [hashlib.sha256(_left(t, *r)).hexdigest() for t, r in zip(texts, runs, strict=True)]
                numbers = [list(map(len, texts)), [int((b - a).sum()) for a, b in runs], [len(a) for a, _ in runs]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, width, crowd).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 100, crowd: int = 4096) -> DataFrame:
    """The documents without what spans() removes, all columns; n_chars, if there, follows the text.

    Characters of which bytes are left over at an edge go, too. A row without text keeps none.
    """
    _checked(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                left = [_left(t, *_runs(x)).decode("utf-8", "ignore") for t, x in zip(texts, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(left, pa.string())], ["doc_id", "old", "new"])

    changed = with_spans(docs, width, crowd).where("spans is not null").mapInArrow(run, "doc_id bigint, old string, new string")
    changed = changed.dropDuplicates(["doc_id", "old"])
    names = [x for x in docs.columns]
    old, new, key = (_fresh(x, names) for x in ("old_text", "new_text", "old_id"))
    changed = changed.toDF(key, old, new)
    rows = docs.join(changed, docs["doc_id"].eqNullSafe(changed[key]) & (docs["text"] == changed[old]), "left")
    text = F.coalesce(F.col(new), docs["text"])
    out = {x: docs[x] for x in names} | {"text": text} | ({"n_chars": F.coalesce(F.length(text), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in names else {})
    return rows.select(*(c.alias(x) for x, c in out.items()))


def _fresh(name: str, used: list[str]) -> str:
    while name in used:
        name += "_"
    return name
