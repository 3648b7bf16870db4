"""Toxic passages by maximum-scoring segments.

Each word (a run of ASCII letters or non-ASCII bytes, A-Z lower-cased) and each of its stems has log-odds of standing in toxic against other
labelled documents, with a Dirichlet prior that follows the words' overall rates. Words count whose share of toxic
documents lies `deviations` standard errors or more from what is expected; each word costs a little. A linear-time scan finds every maximal-scoring segment of a
text. Extreme-value calibration: the largest segment score of label-0 documents follows a Gumbel law whose location
grows with the logarithm of the length, and a logistic curve turns the excess over it, and what all significant segments
add, into a probability.

Word counts cover all labelled training rows. The word table keeps every word that counts; it is broadcast up to
`broadcast_words` words, beyond that the words of texts are joined to it by a shuffle and each text brings its own
part of the table. The few parameters of the calibration are fitted on at most `max_train` labelled documents.

Nulls: a null text counts as empty; a null doc_id stays null; null labels are left out. Empty texts have no segment and
get the calibrated score of no evidence. Repeated rows are scored one by one. A text of any length is read whole, by one task. Only doc_id and text are read. With labels
of one class or none, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textstats import Texts, mix, prefix_hash, span_hash

_FOLD = np.full(256, 32, np.uint8)  # letters in lower case, anything else a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


#: Prefixes of this many bytes stand for a word's stem beside the word itself.
STEMS = (4, 6, 8, 10)


def words(texts: list[bytes]) -> tuple[Texts, list[tuple[np.ndarray, np.ndarray]]]:
    """The folded texts, and for whole words and each length of stem: hashes, and which words have one."""
    folded = _FOLD[np.frombuffer(b" ".join(texts) + b" ", np.uint8)].tobytes()
    ends = np.cumsum([len(x) + 1 for x in texts])
    t = Texts.of([folded[a:b] for a, b in zip([0, *ends[:-1]], ends - 1, strict=True)])
    prefix = prefix_hash(t.buffer)
    kinds = [(span_hash(prefix, t.start, t.end), np.arange(len(t.start)))]
    for k in STEMS:
        at = np.flatnonzero(t.end - t.start > k)
        kinds.append((mix(span_hash(prefix, t.start[at], t.start[at] + k) + np.uint64(k)), at))
    return t, kinds


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of one sequence, in linear time.

    Candidates carry the sums before and behind them; a new candidate joins all those from the last one on with a lower
    sum before it, unless that one's sum behind it is as high.
    """
    positive = scores > 0
    if not positive.any():
        return []
    turn = np.flatnonzero(np.diff(positive.astype(np.int8), prepend=np.int8(0)) == 1)
    stop = np.flatnonzero(np.diff(positive.astype(np.int8), append=np.int8(0)) == -1)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, last, sum before, sum behind
    for a, b in zip(turn.tolist(), stop.tolist(), strict=True):
        item = [a, b, total[a], total[b + 1]]
        while True:
            k = len(found) - 1
            skipped = []
            while k >= 0 and found[k][2] >= item[2]:
                skipped.append(k)
                k -= 1
            if k < 0 or found[k][3] >= item[3]:
                break
            item = [found[k][0], item[1], found[k][2], item[3]]
            del found[k:]
        found.append(item)
    return [(a, b, float(right - left)) for a, b, left, right in found]


@dataclass
class Model:
    keys: np.ndarray
    values: np.ndarray
    cost: float
    rate: float  # of the Gumbel law
    spread: float  # log K
    weights: tuple[float, float, float]
    base: float | None = None
    table: DataFrame | None = None  # word and value, if they are too many to broadcast

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def shared(self, docs: DataFrame) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(replace(self, table=None))

    def prepared(self, docs: DataFrame) -> DataFrame:
        """`docs`, with the part of the table that occurs in each text if the table is not broadcast."""
        if self.table is None:
            return docs

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in common.slices(batch):
                    t, kinds = words(texts)
                    key, at = np.unique(np.concatenate([h for h, _ in kinds]), return_inverse=True)
                    once = np.unique(t.doc[np.concatenate([w for _, w in kinds])] * len(key) + at)
                    doc = part.column(1).to_numpy()[once // max(len(key), 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key.view(np.int64)[once % max(len(key), 1)])], ["text_hash", "word"])

        found = docs.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(pairs, "text_hash bigint, word bigint").distinct()
        found = found.join(self.table, "word").groupBy("text_hash").agg(F.collect_list(F.struct("word", "value")).alias("hits"))
        found = found.select("text_hash", F.col("hits.word").alias("hit_words"), F.col("hits.value").alias("hit_values"))
        return docs.join(found, F.xxhash64(docs["text"]) == found["text_hash"], "left").drop("text_hash")

    def of(self, part: pa.RecordBatch) -> Model:
        """The model with all words of the table that occur in this part."""
        if "hit_words" not in part.schema.names:
            return self
        keys, first = np.unique(part.column("hit_words").flatten().to_numpy().view(np.uint64), return_index=True)
        return replace(self, keys=keys, values=part.column("hit_values").flatten().to_numpy()[first]) if len(keys) else self

    def scores(self, n: int, kinds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of each word: the largest log-odds of the word and its stems or, if none is positive, the least; less the cost."""
        high, low = np.zeros(n), np.zeros(n)
        for hashes, word in kinds:
            at = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            if len(at):
                k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
                hit = self.keys[k] == hashes[at]
                value, where = self.values[k[hit]], word[at[hit]]
                high[where] = np.maximum(high[where], value)
                low[where] = np.minimum(low[where], value)
        return np.where(high > 0, high, low) - self.cost

    def segments(self, texts: list[bytes]) -> tuple[Texts, list[list[tuple[int, int, float]]], np.ndarray]:
        """Words, the maximal segments of each text (word numbers in the batch), and each text's number of words."""
        t, kinds = words(texts)
        s = self.scores(len(t.start), kinds)
        n = np.bincount(t.doc, minlength=len(t))
        cut = np.concatenate([[0], np.cumsum(n)])
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for d in np.unique(t.doc[s > 0]).tolist():
            out[d] = [(a + cut[d], b + cut[d], x) for a, b, x in maximal_segments(s[cut[d] : cut[d + 1]])]
        return t, out, n

    def evidence(self, found: list[list[tuple[int, int, float]]], n: np.ndarray) -> np.ndarray:
        """Excess of the best segment over the Gumbel location, and the logarithm of what all segments exceed it by."""
        location = self.spread + np.log(np.maximum(n, 1))
        best = np.array([max((x for _, _, x in f), default=0.0) for f in found])
        more = np.array([sum(max(0.0, self.rate * x - m) for _, _, x in f) for f, m in zip(found, location, strict=True)])
        return np.column_stack([np.clip(self.rate * best - location, -10, 15), np.log1p(more), np.ones(len(n))])

    def probability(self, found: list[list[tuple[int, int, float]]], n: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(n), self.base)
        return 1 / (1 + np.exp(-np.clip(self.evidence(found, n) @ np.array(self.weights), -40, 40)))


@dataclass
class ToxicPassages:
    prior: float = 2000.0
    deviations: float = 5.0
    least_docs: int = 4
    cost: float = 0.4
    max_train: int = 6000
    #: Words up to this number are broadcast to the documents; more are joined by a shuffle.
    broadcast_words: int = 1_000_000
    #: Labels up to this number of rows are broadcast to the documents; more are joined by a shuffle.
    broadcast_rows: int = 1_000_000

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None) -> Model:
        chosen = labels.select("doc_id", F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
        chosen = chosen if keep is None else chosen.where(keep)
        chosen = chosen.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        n, positive = chosen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        if positive in (0, n):
            return Model(np.zeros(1, np.uint64), np.zeros(1), self.cost, 1.0, 0.0, (0.0, 0.0, 0.0), (positive + 1) / (n + 2))
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen) if n <= self.broadcast_rows else chosen, "doc_id")
        table = self.log_odds(rows)
        if table.count() > self.broadcast_words:
            model = Model(np.zeros(1, np.uint64), np.zeros(1), self.cost, 1.0, 0.0, (1.0, 0.0, 0.0), table=table)
        else:
            model = Model(*self.collected(table), self.cost, 1.0, 0.0, (1.0, 0.0, 0.0))
            common.discard(table)
        return self.calibrated(common.labelled_sample(docs, labels, label, self.max_train, keep), model)

    @staticmethod
    def collected(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = table.toArrow()
        key, value = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
        order = np.argsort(key)
        return (key[order], value[order]) if len(key) else (np.zeros(1, np.uint64), np.zeros(1))

    def log_odds(self, rows: DataFrame) -> DataFrame:
        """All words (by hash) whose toxic share lies beyond `deviations` standard errors, and their log-odds."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[np.ndarray] = []  # hashes as a column, then four counts

            def flush() -> pa.RecordBatch:
                key, at = np.unique(np.concatenate([x[0] for x in waiting]), return_inverse=True)
                sums = [np.bincount(at, np.concatenate([x[k] for x in waiting])).astype(np.int64) for k in range(1, 5)]
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, sums)], ["word", "bad", "total", "bad_docs", "docs"])

            for batch in batches:
                for part, texts in common.slices(batch, most=4 << 20):
                    t, kinds = words(texts)
                    hashes = np.concatenate([h for h, _ in kinds])
                    of = t.doc[np.concatenate([w for _, w in kinds])]
                    label = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                    key, at = np.unique(hashes, return_inverse=True)
                    _, once = np.unique(at * len(t) + of, return_index=True)
                    sums = [np.bincount(x, w, len(key)) for x, w in ((at, label[of]), (at, None), (at[once], label[of[once]]), (at[once], None))]
                    waiting.append((key, *sums))
                    if sum(len(x[0]) for x in waiting) > 1_000_000:
                        yield flush()
                        waiting.clear()
            if waiting:
                yield flush()

        sums = ("bad", "total", "bad_docs", "docs")
        table = rows.select("text", "label").mapInArrow(lambda b: count(x.select(["text", "label"]) for x in b), "word bigint, bad bigint, total bigint, bad_docs bigint, docs bigint")
        table = common.staged(table.groupBy("word").agg(*(F.sum(x).alias(x) for x in sums)), "toxic-words")
        bad, total = (float(x or 0) for x in table.agg(F.sum("bad"), F.sum("total")).first())
        n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
        prior = F.col("total") * (self.prior / max(total, 1)) + 0.5
        a, b = F.col("bad") + prior, F.col("total") - F.col("bad") + prior
        odds = lambda x, m: F.log(x / (m + self.prior - x))
        expected = F.col("docs") * (toxic / n)
        z = (F.col("bad_docs") - expected) / F.sqrt(expected * (1 - toxic / n))
        strong = table.withColumn("z", z).where((F.abs("z") >= self.deviations) & (F.greatest("bad_docs", F.col("docs") - F.col("bad_docs")) >= self.least_docs))
        strong = strong.withColumn("value", odds(a, F.lit(bad)) - odds(b, F.lit(total - bad)))
        found = common.staged(strong.select("word", "value"), "toxic-strong")
        common.discard(table)
        return found

    def calibrated(self, sample: DataFrame, model: Model) -> Model:
        shared = model.shared(sample)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in common.slices(batch):
                    _, found, n = shared.value.of(part).segments(texts)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(n.astype(np.int64)), pa.array([[x for _, _, x in f] for f in found], pa.list_(pa.float64()))], ["doc_id", "label", "n", "found"])

        rows = model.prepared(sample).mapInArrow(run, "doc_id bigint, label int, n bigint, found array<double>").toArrow().sort_by("doc_id")
        y, n = rows.column("label").to_numpy().astype(float), rows.column("n").to_numpy()
        found = [[(0, 0, x) for x in f] for f in rows.column("found").to_pylist()]
        best = np.array([max((x for _, _, x in f), default=0.0) for f in found])
        # Gumbel law of label-0 maxima: rate by moments, then the likeliest K
        clean = (y == 0) & (n > 0)
        excess = best[clean]
        if clean.any():
            model.rate = float(np.pi / np.sqrt(6) / max(best[clean].std(), 0.25))
            model.spread = float(np.log(clean.sum() / (n[clean] * np.exp(-np.clip(model.rate * best[clean], None, 50))).sum()))
        x = model.evidence(found, n)
        w = np.zeros(3)
        ridge = np.array([1e-2, 1e-2, 1e-4])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
            w = w - step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        model.weights = tuple(float(v) for v in w)
        return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_segments of every document."""
    shared = model.shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                _, found, n = shared.value.of(part).segments(texts)
                p = shared.value.probability(found, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(f) for f in found], pa.int64())], ["doc_id", "score", "predicted", "n_segments"])

    return model.prepared(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, score double, predicted int, n_segments bigint")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every maximal-scoring segment beyond the Gumbel location: doc_id, first and last byte, score, its text."""
    shared = model.shared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in common.slices(batch):
                t, found, n = m.of(part).segments(texts)
                ids = part.column(0).to_pylist()
                rows = []
                for d, f in enumerate(found):
                    location = m.spread + np.log(max(n[d], 1))
                    for a, b, x in f:
                        if m.rate * x > location:
                            i, j = int(t.start[a] - t.first[d]), int(t.end[b] - t.first[d])
                            rows.append((ids[d], i, j, x, texts[d][i:j].decode("utf-8", "replace")))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "start", "end", "score", "passage"])

    return model.prepared(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, start bigint, end bigint, score double, passage string")
