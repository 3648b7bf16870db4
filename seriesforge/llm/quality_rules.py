"""Quality rules by a hashed n-gram logistic regression, calibrated and scored in Arrow batches.

Word unigrams and bigrams and character n-grams (3 and 4 code points) are hashed into one weight table; a text's features
are the mean rates of its hashed n-grams, family by family. The regression is fitted on a bounded sample of labelled
documents (`max_train`), in one task that takes the sample's features and returns the weights; its output is calibrated by
a logistic curve on a part of the sample that the fit did not see, and a document is kept if its calibrated probability
of label 1 reaches `threshold` and it passes the base rule: 20 words at least, and at most 30 % of its words in 8-word
windows that the text repeats.

Nulls: a null text counts as empty (base rule fails); a null doc_id is returned as null. Empty tables give no rows.
Repeated rows are scored one by one. A text of any length is read whole. Other columns are ignored by score() and kept
as they are by kept(). With labels of one class only or none, the probability is the (smoothed) share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .textstats import Texts, counts, mix

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def hashed(t: Texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram family: the slot of each n-gram in the weight table, and its document."""
    down = np.uint64(64 - bits)
    golden = np.uint64(0x9E3779B97F4A7C15)
    words = t.word_hashes()
    out = [(mix(words) >> down, t.doc)]
    pairs = np.flatnonzero(t.doc[1:] == t.doc[:-1])
    a, b = words[pairs], words[pairs + 1]
    pair = np.where(a == b, np.uint64(1), a * np.uint64(3) + mix(b))  # a word twice running is one pattern, whatever the word
    out.append((mix(pair + golden) >> down, t.doc[pairs]))
    letters, doc = characters(t)
    code = letters * _ODD[0]
    for order in (2, 3, 4):
        code = code[:-1] + letters[order - 1 :] * _ODD[order - 1]
        if order > 2:
            at = doc[: len(code)] == doc[order - 1 :]
            out.append(((code[at] + np.uint64(order)) * golden >> down, doc[: len(code)][at]))
    return out


#: Odd numbers without pattern, one for each place in an n-gram.
_ODD = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def characters(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each code point of the texts as a number, its bytes, and its document."""
    starts = (t.buffer & 0xC0) != 0x80
    if starts.all():
        return t.buffer.astype(np.uint64), np.repeat(np.arange(len(t)), t.last - t.first + 1)
    first = np.flatnonzero(starts)
    wide = np.diff(np.append(first, len(t.buffer)))
    letters = t.buffer[first].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(wide > k)
        if len(more):
            letters[more] |= t.buffer[first[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return letters, np.repeat(np.arange(len(t)), np.diff(np.append(np.searchsorted(first, t.first), len(first))))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int
    threshold: float

    def probability(self, t: Texts) -> np.ndarray:
        z = np.full(len(t), self.bias)
        for slot, doc in hashed(t, self.bits):
            z += SCALE * np.bincount(doc, self.weights[slot], len(t)) / np.maximum(np.bincount(doc, minlength=len(t)), 1)
        return sigmoid(self.slope * z + self.offset)


#: Rates of single n-grams are small; this brings the features to the scale of the bias.
SCALE = 30.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic curve from scores to labels, by damped Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g, w = p - target, p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        size = min(1.0, 2 / max(abs(da), abs(db), 1e-12))
        a, b = a - size * da, b - size * db
    return float(max(a, 1e-3)), float(b)


@dataclass
class QualityRules:
    """max_train: labelled documents that the fit takes at most; bits: log2 of the table's size."""

    max_train: int = 2000
    bits: int = 18
    threshold: float = 0.5
    steps: int = 50
    penalty: float = 1e-4

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
        bits = self.bits

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in common.slices(batch):
                    t = Texts.of(texts)
                    keys, values = [], []
                    for slot, doc in hashed(t, bits):
                        n = np.maximum(np.bincount(doc, minlength=len(t)), 1)
                        key, count = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | slot, return_counts=True)
                        keys.append(key)
                        values.append(SCALE * count / n[(key >> np.uint64(bits)).astype(np.int64)])
                    key, value = np.concatenate(keys), np.concatenate(values).astype(np.float32)
                    order = np.argsort(key, kind="stable")
                    key, value = key[order], value[order]
                    cut = np.searchsorted(key >> np.uint64(bits), np.arange(len(t) + 1).astype(np.uint64))
                    slot = (key & np.uint64((1 << bits) - 1)).astype(np.uint32)
                    cuts = list(zip(cut[:-1], cut[1:], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("label"), pa.array([slot[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cuts], pa.binary())],
                        ["doc_id", "label", "slots", "rates"],
                    )

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [(i, y, np.frombuffer(s, np.uint32), np.frombuffer(r, np.float32)) for b in batches for i, y, s, r in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            m = self.regress(*(list(x) for x in zip(*rows, strict=True))) if rows else self.regress([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([[m.bias, m.slope, m.offset]])], ["weights", "numbers"])

        sample = common.labelled_sample(docs, labels, label, self.max_train)
        rows = sample.mapInArrow(features, "doc_id bigint, label int, slots binary, rates binary")
        found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(solve, "weights binary, numbers array<double>").first()  # max_train rows
        if found is None:
            return self.regress([], [], [], [])
        return Model(np.frombuffer(found["weights"], np.float32), *found["numbers"], self.bits, self.threshold)

    def regress(self, ids: list[int], label: list[int], slots: list[np.ndarray], rates: list[np.ndarray], block: int = 128) -> Model:
        """Accelerated gradient descent on four fifths of the sample, calibration on the rest; `block` texts at a time."""
        y = np.array(label, float)
        base = (y.sum() + 1) / (len(y) + 2)
        if len(set(label)) < 2:
            return Model(np.zeros(1 << self.bits, np.float32), float(np.log(base / (1 - base))), 1.0, 0.0, self.bits, self.threshold)
        held = (mix(np.array(ids, np.int64).view(np.uint64)) % np.uint64(5)) == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        share = np.where(held, 0, np.where(y == 1, 0.5 / max(y[~held].sum(), 1), 0.5 / max((1 - y[~held]).sum(), 1)))
        size = 1 << self.bits
        blocks = []
        for i in range(0, len(y), block):
            row = np.repeat(np.arange(min(block, len(y) - i)), [len(x) for x in slots[i : i + block]]).astype(np.int32)
            blocks.append((slice(i, i + block), row, np.concatenate(slots[i : i + block]), np.concatenate(rates[i : i + block])))
            slots[i : i + block] = rates[i : i + block] = [None] * (min(block, len(y) - i))

        def outputs(w: np.ndarray, b: float) -> np.ndarray:
            return np.concatenate([np.bincount(row, w[col] * val, len(y[at])) for at, row, col, val in blocks]) + b

        w, b, v, bv, momentum = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
        rate = 4 / (1 + max(float(np.bincount(row, np.square(val, dtype=float), 1).max()) for _, row, _, val in blocks))
        for _ in range(self.steps):
            g = share * (sigmoid(outputs(v, bv)) - y)
            w_next = (1 - rate * self.penalty) * v
            for at, row, col, val in blocks:
                np.subtract(w_next, rate * np.bincount(col, g[at][row] * val, size), out=w_next)
            b_next = bv - rate * g.sum()
            following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            v, bv = w_next + (momentum - 1) / following * (w_next - w), b_next + (momentum - 1) / following * (b_next - b)
            w, b, momentum = w_next, b_next, following
        z = outputs(w, b)
        held = held if held.any() else np.ones(len(y), bool)
        slope, offset = calibrate(z[held], y[held])
        return Model(w.astype(np.float32), float(b), slope, offset, self.bits, self.threshold)


def verdicts(model: Model, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts, probability, base_failed and kept of each text."""
    t = Texts.of(texts)
    out = counts(t)
    out["probability"] = model.probability(t)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["probability"] >= model.threshold)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the five counts (long), base_failed, kept and probability of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                v = verdicts(shared.value, texts)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v[x].astype(np.int64)) for x in FIELDS), pa.array(v["base_failed"]), pa.array(v["kept"]), pa.array(v["probability"])], ["doc_id", *FIELDS, "base_failed", "kept", "probability"])

    kinds = ", ".join(f"{x} bigint" for x in ["doc_id", *FIELDS])
    return docs.select("doc_id", "text").mapInArrow(run, f"{kinds}, base_failed boolean, kept boolean, probability double")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are kept, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                yield part.filter(pa.array(verdicts(shared.value, texts)["kept"]))

    return docs.mapInArrow(run, docs.schema)
