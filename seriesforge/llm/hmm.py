"""Language-model scoring with a hidden Markov model.

Tokens: white-space words with A-Z lower-cased, then one end per text. The most frequent training words, at most
`max_words`, have emissions of their own, a table of bounded size that tasks hold whole. All others, also unseen ones,
belong to one of `tails` classes, by a hash of their first two and last three bytes; inside a class the smoothed unigram
model divides the class's probability, so each word's own count tells, however rare it is. The one type for all unseen
words is dealt out over the classes in proportion to their words that occur once: more classes fit training texts
better, but cost every unseen word the logarithm of its class's share. So every token has a positive probability, and all tokens' probabilities add
up to 1.

Baum-Welch: each task gathers expected emission, transition and start counts over whole training texts; counts are
added up by class block across tasks, first within every `FAN` tasks. Rounds go on until the likelihood gains less than
`gain` a token, `rounds` times at most.
Scores are exact: the scaled forward recursion runs over the whole text, however long. Counts of words outside the
vocabulary reach their documents by a join.

Nulls: a null text is empty, its only token is the end. A null doc_id is kept and belongs to fold 0. Repeated rows are
scored each. A text of any length is one sequence; a task holds `states` floats for each of its tokens at a time. An
empty table gives no rows; without training texts score and base_score are those of the empty unigram model (0). Only
doc_id and text are read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 1024  # classes whose counts travel in one row
FAN = 64  # tasks whose counts are added up first
SPREAD = 8192  # tokens whose expected counts are added up while a core still has them
LONGEST = 64  # bytes of a word in the vocabulary, which bounds its size


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and ASCII white space only


@dataclass
class Unigram:
    """Smoothed by 0.5 a type, with one type for all unseen tokens."""

    total: int
    types: int

    def log10(self, count: Column) -> Column:
        return F.log10((count + 0.5) / F.lit(self.total + 0.5 * (self.types + 1)))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.types + 1))


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[:2] + word[-3:]) % tails


def tail_class_column(word: str, tails: int) -> Column:
    """tail_class() of a binary column."""
    return (F.crc32(F.concat(F.substring(word, 1, 2), F.substring(word, -3, 3))) % tails).cast("int")


@dataclass
class Model:
    """start: of texts; step: transitions; emit: one row per class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def forward(model: Model, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the likelihood of each sequence; `ids` has them one behind another."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right").tolist()
    total = np.zeros(len(sizes))
    state, other = np.tile(model.start, (len(sizes), 1)), np.empty((len(sizes), len(model.start)))
    one = np.ones(len(model.start))
    for t, n in enumerate(active):
        if t:
            state, other = np.matmul(state[:n], model.step, out=other[:n]), state
        state *= model.emit.take(ids[first[:n] + t], 0, mode="clip")
        scale = state @ one
        state /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty_like(total)
    out[order] = total
    return out


class Expected:
    """Sums of expected counts over whole sequences, at most `most` tokens (or one sequence) at a time."""

    def __init__(self, model: Model, most: int = 1_000_000) -> None:
        self.model, self.most = model, most
        k, classes = model.emit.shape[1], len(model.emit)
        odd = (0, k % 2)  # counts are added up in pairs, so a state that is never taken makes them even
        self._emit32, self._step32, self._start32 = (np.pad(x.astype(np.float32), p) for x, p in ((model.emit, ((0, 0), odd)), (model.step, (odd, odd)), (model.start, odd)))
        self._pairs = np.zeros(classes * (k + k % 2) // 2, np.complex128)
        self.emit = self._pairs.view(np.float64).reshape(classes, -1)[:, :k].T
        self.step, self.start, self.loss, self.n = np.zeros((k, k)), np.zeros(k), 0.0, 0

    def add(self, sequences: list[np.ndarray]) -> None:
        some: list[np.ndarray] = []
        size = 0
        for x in sorted((x for x in sequences if len(x)), key=len, reverse=True):
            if some and size + len(x) > self.most:
                self._add(some)
                some, size = [], 0
            some.append(x)
            size += len(x)
        if some:
            self._add(some)

    def _add(self, sequences: list[np.ndarray]) -> None:
        """Longest first. Tokens lie in order of time: those of time t from at[t] on, one of each sequence that long."""
        sizes = np.array([len(x) for x in sequences])
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        at = np.concatenate([[0], np.cumsum(active)]).tolist()
        ids = np.empty(at[-1], np.int64)
        begin = np.array(at[:-1])
        for j, x in enumerate(sequences):
            ids[begin[: len(x)] + j] = x
        k, wide = len(self.step), len(self._step32)
        alpha, scale = np.empty((len(ids), wide), np.float32), np.empty(len(ids), np.float32)
        buffer, one, back = np.empty((int(active[0]), wide), np.float32), np.ones(wide, np.float32), np.ascontiguousarray(self._step32.T)
        for t in range(len(begin)):
            now, n = slice(at[t], at[t + 1]), at[t + 1] - at[t]
            x = self._emit32.take(ids[now], 0, alpha[now], "clip")  # unlike "raise" without a copy
            x *= np.matmul(alpha[at[t - 1] : at[t - 1] + n], self._step32, out=buffer[:n]) if t else self._start32
            x /= np.matmul(x, one, out=scale[now])[:, None]
        moved = np.zeros_like(self._step32, np.float64)
        beta, left = np.ones((int(active[0]), wide), np.float32), len(ids)
        for t in range(len(begin) - 1, 0, -1):
            now, n = slice(at[t], at[t + 1]), at[t + 1] - at[t]
            x, after = self._emit32.take(ids[now], 0, buffer[:n], "clip"), beta[:n]
            x *= after
            x /= scale[now, None]
            moved += alpha[at[t - 1] : at[t - 1] + n].T @ x
            alpha[now] *= after  # the states' probabilities
            np.matmul(x, back, out=after)
            if left - at[t] >= SPREAD:
                self._spread(ids[at[t] : left], alpha[at[t] : left])
                left = at[t]
        alpha[: at[1]] *= beta
        self.step += moved[:k, :k] * self.model.step
        self.start += alpha[: at[1], :k].sum(axis=0)
        self._spread(ids[:left], alpha[:left])
        self.loss += float(np.log10(scale.astype(float)).sum())
        self.n += len(ids)

    def _spread(self, ids: np.ndarray, counts: np.ndarray) -> None:
        pair = np.arange(counts.shape[1] // 2)
        for i in range(0, len(ids), 2 * SPREAD):
            part = counts[i : i + 2 * SPREAD].reshape(-1).view(np.complex64).astype(np.complex128)
            np.add.at(self._pairs, (ids[i : i + 2 * SPREAD, None] * len(pair) + pair).reshape(-1), part)


def refined(emit: np.ndarray, step: np.ndarray, start: np.ndarray, base: np.ndarray, strength: float) -> Model:
    """The model that expected counts give, with Dirichlet priors: classes' overall rates, and a little everywhere."""
    emit = emit + strength * base
    step = step + 0.5
    start = start + 0.5
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))


def begun(base: np.ndarray, states: int, seed: int) -> Model:
    """Sticky states with perturbed emissions."""
    emit = base * np.exp(np.random.default_rng(seed).normal(0, 1, (states, len(base))))
    return refined(1e3 * emit, 50 * np.eye(states), np.ones(states), base, 1.0)


@dataclass
class HiddenMarkov:
    """rounds: at most so many, each over all training texts; gain: of log10 likelihood a token, below it they end."""

    states: int = 16
    max_words: int = 64_000
    tails: int = 1
    rounds: int = 12
    gain: float = 0.002
    strength: float = 50.0
    seed: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.tails or self.max_words + self.tails >= 1 << 16:
            raise ValueError("max_words and tails must stay below 65,536 together")

    def score(self, docs: DataFrame, held_out: Column) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; `held_out` is a condition on doc_id."""
        spark = docs.sparkSession
        tails = self.tails  # classes below it are tails, then the end, then words
        rows = docs.select("doc_id", "text", held_out.alias("held_out"))
        counts = common.staged(self._counts(rows.where(~F.col("held_out"))), "word-counts")
        total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        unigram = Unigram(total, types)
        top = self._top(counts.where(F.col("word").isNotNull() & (F.length("word") <= LONGEST)))
        ends = (counts.where("word is null").agg(F.sum("n")).first() or [0])[0] or 0
        number = {word: i + tails + 1 for i, (word, _) in enumerate(top)}
        base = np.concatenate([np.zeros(tails), unigram.probability(np.array([ends, *(n for _, n in top)], float))])
        of_tails = counts.where("word is not null").groupBy(tail_class_column("word", tails).alias("class"))
        once = np.zeros(tails)
        for k, words_, tokens, single in of_tails.agg(F.count("*"), F.sum("n"), F.sum((F.col("n") == 1).cast("long"))).collect():  # one row a class
            base[k], once[k] = (tokens + 0.5 * words_) / (total + 0.5 * (types + 1)), single
        np.subtract.at(base, [tail_class(w, tails) for w, _ in top], unigram.probability(np.array([n for _, n in top], float)))
        once = (once + 0.5) / (once + 0.5).sum()  # of an unseen word
        base[:tails] = np.maximum(base[:tails], 0) + once * unigram.probability(np.zeros(1))[0] if total else 1 / tails
        coded = common.staged(self._coded(rows, number, np.log10(once)).withColumn("uid", F.monotonically_increasing_id()), "coded")
        train = coded.where(~F.col("held_out")).select("ids")
        model = self.train(train, base) if total else Model(np.ones(1), np.ones((1, 1)), np.ones((len(base), 1)))
        logs = spark.sparkContext.broadcast((model, np.log10(base)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, log10 = logs.value

            def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                whole = pa.Table.from_batches(held)
                ids = [np.frombuffer(x, "<u2") for x in whole.column("ids").to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids)
                of = np.repeat(np.arange(len(ids)), sizes)
                listed = flat >= tails
                known = np.bincount(of, listed, len(ids)).astype(np.int64)
                plain = np.bincount(of, np.where(listed, log10[flat], 0.0), len(ids))
                chain = forward(model, flat, sizes) - np.bincount(of, np.where(listed, 0.0, log10[flat]), len(ids))
                columns = [pa.array(x) for x in (sizes, known, plain, chain)]
                return pa.RecordBatch.from_arrays([*(whole.column(x).combine_chunks() for x in ("uid", "doc_id", "held_out")), *columns], ["uid", "doc_id", "held_out", "n_tokens", "listed", "plain", "chain"])

            held, size = [], 0
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    held.append(part)
                    size += part.column(part.schema.get_field_index("ids")).nbytes
                    if size > 8 << 20:
                        yield done(held)
                        held, size = [], 0
            if held:
                yield done(held)

        known = coded.select("uid", "doc_id", "held_out", "ids").mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, listed bigint, plain double, chain double")
        tail = coded.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n", F.col("t.rare") if tails > 1 else F.lit(0.0).alias("rare"))
        seen = counts.where("word is not null").select("word", F.col("n").alias("c"))
        tail = tail.join(seen, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        new = F.col("c") == 0
        tail = tail.groupBy("uid").agg(F.sum(F.when(new, 0).otherwise(F.col("n"))).alias("known"), F.sum(F.col("n") * unigram.log10(F.col("c"))).alias("logs"), F.sum(F.when(new, F.col("rare")).otherwise(0.0)).alias("rare"))
        logs_, rare, more = (F.coalesce(x, F.lit(0)) for x in ("logs", "rare", "known"))
        return known.join(tail, "uid", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("listed") + more if total else F.lit(0)).cast("bigint").alias("n_known"),
            F.lit(total).cast("bigint").alias("train_tokens"), (F.col("plain") + logs_ if total else F.lit(0.0)).alias("base_score"), (F.col("chain") + logs_ + rare if total else F.lit(0.0)).alias("score"),
        )

    def _top(self, counts: DataFrame) -> list[tuple[bytes, int]]:
        """The max_words most frequent words, the most frequent first; of the last level of counts some, by hash."""
        upto = F.sum("words").over(Window.orderBy(F.desc("n")))
        levels = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", upto)  # one row per distinct count
        whole = levels.where(F.col("upto") <= self.max_words).agg(F.min("n"), F.max("upto")).first()
        cut = levels.where(F.col("upto") > self.max_words).orderBy(F.desc("n")).select("n", "words").first()
        least, room = whole[0], self.max_words - (whole[1] or 0)
        chosen = F.lit(False) if least is None else F.col("n") >= least
        if cut is not None:
            share = int(0.95 * room / cut["words"] * (1 << 30))
            chosen |= (F.col("n") == cut["n"]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share)
        rows = sorted(((bytes(r["word"]), r["n"]) for r in counts.where(chosen).toLocalIterator()), key=lambda r: (-r[1], r[0]))
        return rows[: self.max_words]

    def train(self, coded: DataFrame, base: np.ndarray) -> Model:
        """Baum-Welch over all rows of `coded` (ids)."""
        model = begun(base, self.states, self.seed)
        before = -np.inf
        for _ in range(self.rounds):
            model, loss = self.round(coded, model, base)
            if loss - before < self.gain:
                break
            before = loss
        return model

    def round(self, coded: DataFrame, model: Model, base: np.ndarray) -> tuple[Model, float]:
        """The next model, and log10 of the likelihood of a token under the given one."""
        shared = coded.sparkSession.sparkContext.broadcast(model)  # states x classes floats

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = Expected(shared.value)
            held, size = [], 0
            for batch in batches:
                for x in batch.column(0):
                    held.append(np.frombuffer(x.as_py(), "<u2"))
                    size += len(held[-1])
                    if size > 4_000_000:
                        e.add(held)
                        held, size = [], 0
            e.add(held)
            if not e.n:
                return
            blocks = [(i // BLOCK, e.emit[:, i : i + BLOCK]) for i in range(0, e.emit.shape[1], BLOCK)]
            rows = [(k, x.astype("<f4").tobytes()) for k, x in blocks if x.any()] + [(-1, np.concatenate([e.step.ravel(), e.start, [e.loss, e.n]]).astype("<f8").tobytes())]
            task = TaskContext.get().partitionId() // FAN
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "task", "counts"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of equal (block, task) in a row; block -1 has doubles, the others floats."""
            key, total = None, np.zeros(0)

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<f8" if key[0] < 0 else "<f4").tobytes()], pa.binary())], ["block", "task", "counts"])

            for batch in batches:
                for block, task, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                    this, x = (block.as_py(), task.as_py()), np.frombuffer(counts.as_py(), "<f8" if block.as_py() < 0 else "<f4")
                    if this == key:
                        total = total + x
                        continue
                    if key is not None:
                        yield out()
                    key, total = this, x.astype(float)
            if key is not None:
                yield out()

        kinds = "block int, task int, counts binary"
        sums = coded.mapInArrow(run, kinds).repartition("block", "task").sortWithinPartitions("block", "task").mapInArrow(add, kinds)
        sums = sums.repartition("block").sortWithinPartitions("block").mapInArrow(add, kinds)
        k = self.states
        emit, rest = np.zeros((k, len(base))), np.zeros(k * k + k + 2)
        for block, _, counts in sums.collect():  # states x classes floats in all
            if block >= 0:
                emit[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, "<f4").reshape(k, -1)
            else:
                rest = np.frombuffer(counts, "<f8")
        shared.unpersist()
        step, start, (loss, n) = rest[: k * k].reshape(k, k), rest[k * k : -2], rest[-2:]
        return refined(emit, step, start, base, self.strength), loss / max(n, 1)

    @staticmethod
    def _counts(rows: DataFrame) -> DataFrame:
        """word (binary, null for the end) and its count n."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter[bytes] = Counter()

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

            ends = 0
            for batch in batches:
                ends += batch.num_rows
                for _, texts in common.slices(batch):
                    for x in texts:
                        held.update(words(x))
                    if len(held) > 500_000:
                        yield out()
                        held = Counter()
            yield out()
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

        return rows.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    def _coded(self, rows: DataFrame, number: dict[bytes, int], log_once: np.ndarray) -> DataFrame:
        """doc_id, held_out, ids (classes as unsigned 16-bit), tail: words of tail classes, their counts n, and n times
        the logarithm of what unseen words of their class have of all unseen ones.
        """
        shared = rows.sparkSession.sparkContext.broadcast((number, log_once.tolist()))  # max_words words of LONGEST bytes at most
        tails, end = self.tails, np.array(self.tails, "<u2").tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, logs = shared.value
            for batch in batches:
                for part, texts in common.slices(batch):
                    coded, ends, tail, times, rare = [], [0], [], [], []
                    for x in texts:
                        w = words(x)
                        ids = np.fromiter(map(number.get, w, itertools.repeat(0)), np.uint16, len(w))
                        other = np.flatnonzero(ids == 0).tolist()
                        if other:
                            counted = Counter(map(w.__getitem__, other))
                            tail += counted
                            times += counted.values()
                            if tails > 1:
                                classes = {t: tail_class(t, tails) for t in counted}
                                ids[other] = [classes[w[i]] for i in other]
                                rare += [n * logs[classes[t]] for t, n in counted.items()]
                            else:
                                rare += [n * logs[0] for n in counted.values()]
                        ends.append(len(tail))
                        coded.append(ids.astype("<u2").tobytes() + end)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(times, pa.int64()), pa.array(rare, pa.float64())], ["word", "n", "rare"]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(coded, pa.binary()), lists], ["doc_id", "held_out", "ids", "tail"])

        return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id bigint, held_out boolean, ids binary, tail array<struct<word: binary, n: bigint, rare: double>>")
