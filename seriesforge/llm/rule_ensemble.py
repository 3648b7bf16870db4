"""Quality classifier as a sparse rule ensemble.

Statistics of a text (lengths, rates, repetitions) feed small boosted trees; every path from a root to a node is a
conjunctive rule; a lasso logistic regression keeps few rules, and those are compiled into one Spark column expression
over the statistics. The fit takes at most `max_train` labelled documents; the statistics read whole texts.

Nulls: a null text counts as empty, an empty text has statistics of zero and a score like any other; a null doc_id stays
null. Empty tables give no rows. Repeated rows are scored one by one. Only doc_id and text are read, so further columns
never clash. With labels of one class or none, the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textstats import SPACE, SYMBOL, Texts, counts, mix

_DIGIT, _UPPER, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58], _UPPER[65:91] = True, True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STATISTICS = ["words", "mean_word", "symbol_rate", "marked_words", "dup_lines", "repeats", "distinct", "same_next", "digit_rate", "upper_rate", "punct_rate", "line_words", "top_word", "short_words", "wide_rate", "longest_word", "space_rate"]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row for each text, columns as in STATISTICS."""
    t = Texts.of(texts)
    c = counts(t)
    n = np.maximum(c["n_words"], 1)
    size = np.maximum(t.last - t.first, 1)
    length = t.end - t.start
    marks = np.concatenate([[0], np.cumsum(SYMBOL[t.buffer])])
    hashes = t.word_hashes()
    key = mix(hashes ^ mix(t.doc.astype(np.uint64)))
    _, one, each = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(len(t))
    np.maximum.at(top, t.doc[one], each)
    longest = np.zeros(len(t))
    np.maximum.at(longest, t.doc, length)
    same = (hashes[1:] == hashes[:-1]) & (t.doc[1:] == t.doc[:-1])
    per = t.words_per_doc
    lines = t.per_doc(t.buffer == 10) + 1
    columns = [
        c["n_words"], c["word_chars"] / n, c["n_symbols"] / size, per(marks[t.end] > marks[t.start]) / n, c["n_dup_lines"] / lines, c["n_repeat_words"] / n,
        np.bincount(t.doc[one], minlength=len(t)) / n, np.bincount(t.doc[1:][same], minlength=len(t)) / n, *(t.per_doc(x[t.buffer]) / size for x in (_DIGIT, _UPPER, _PUNCT)),
        c["n_words"] / lines, top / n, per(length <= 2) / n, t.per_doc(t.buffer >= 0xC0) / size, longest, t.per_doc(SPACE[t.buffer]) / size,
    ]
    return np.column_stack([np.asarray(x, float) for x in columns])


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the statistics of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in common.slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in keep), *map(pa.array, statistics(texts).T)], [*keep, *STATISTICS])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([f"{x} {kinds[x]}" for x in keep] + [f"{x} double" for x in STATISTICS]))


Condition = tuple[int, bool, float]  # statistic, above, bound


@dataclass
class Rules:
    """A fitted ensemble: score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[Condition, ...]]
    weights: list[float]

    def column(self) -> Column:
        """The score as an expression over the columns of STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(Column.__and__, [F.col(STATISTICS[k]) > F.lit(x) if above else F.col(STATISTICS[k]) <= F.lit(x) for k, above, x in rule])
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {x:.6g}" for k, above, x in r) for r, w in zip(self.rules, self.weights, strict=True)]


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > b) == above for k, above, b in rule])


def grow(x: np.ndarray, bins: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Condition, ...], float]]:
    """Paths of a tree on gradients g and curvatures h, each with its node's value; splits at quantiles."""
    out = []

    def split(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        if path:
            out.append((path, -G / (H + 1), rows))
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, 0, 0.0)
        for k in columns:
            slot = np.searchsorted(bins[k], x[rows, k], "left")  # slot <= j: value <= bins[j]
            m = len(bins[k])
            gs, hs, ns = (np.cumsum(np.bincount(slot, w, m + 1))[:m] for w in (g[rows], h[rows], None))
            gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            if m and gain.max() > best[0]:
                best = (gain.max(), k, bins[k][gain.argmax()])
        if best[0] > 1e-6:
            _, k, bound = best
            low = x[rows, k] <= bound
            split(rows[low], (*path, (int(k), False, float(bound))))
            split(rows[~low], (*path, (int(k), True, float(bound))))

    split(np.arange(len(x)), ())
    return [(p, v) for p, v, _ in out]


def lasso(r: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an l1 penalty by accelerated proximal gradient steps."""
    rate = 4 / (np.linalg.norm(r * np.sqrt(share)[:, None], 2) ** 2 + 1)
    w = v = np.zeros(r.shape[1])
    b = bv = 0.0
    t = 1.0
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-np.clip(r @ v + bv, -40, 40))) - y)
        step = v - rate * (r.T @ g)
        w_next = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b_next = bv - rate * g.sum()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, bv = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, b


@dataclass
class RuleEnsemble:
    max_train: int = 6000
    trees: int = 30
    depth: int = 3
    seed: int = 11
    penalties: tuple[float, ...] = (0.02, 0.007, 0.002, 0.0007)

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None) -> Rules:
        sample = common.labelled_sample(docs, labels, label, self.max_train, keep)
        rows = with_statistics(sample, "doc_id", "label").toArrow().sort_by("doc_id")
        return self.learn(np.column_stack([rows.column(x).to_numpy() for x in STATISTICS]), rows.column("label").to_numpy())

    def learn(self, x: np.ndarray, y: np.ndarray) -> Rules:
        y = np.asarray(y, float)
        base = (y.sum() + 1) / (len(y) + 2)
        if y.sum() in (0, len(y)):
            return Rules(float(np.log(base / (1 - base))), [], [])
        random = np.random.default_rng(self.seed)
        bins = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49)))[:] for c in x.T]
        z = np.full(len(y), np.log(base / (1 - base)))
        rules: dict[tuple[Condition, ...], None] = {}
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            rows = random.permutation(len(y))[: max(len(y) // 2, min(len(y), 200))]
            columns = random.permutation(x.shape[1])[:8]
            paths = grow(x[rows], bins, (p - y)[rows], (p * (1 - p))[rows], columns, self.depth, max(5, len(rows) // 400))
            inner = {p[:-1] for p, _ in paths}
            for path, value in paths:
                rules[path] = None
                if path not in inner:
                    z += 0.3 * np.clip(value, -4, 4) * holds(path, x)
        rules = list(rules)
        r = np.column_stack([holds(p, x) for p in rules]).astype(float) if rules else np.zeros((len(y), 0))
        test = np.arange(len(y)) % 5 == 0
        share = np.full(len(y), 1 / len(y))

        def loss(w: np.ndarray, b: float) -> float:
            s = np.where(y[test] == 1, 1, -1) * (r[test] @ w + b)
            return np.logaddexp(0, -s).mean()

        penalty = min(self.penalties, key=lambda q: loss(*lasso(r[~test], y[~test], share[~test] * 1.25, q)))
        w, b = lasso(r, y, share, penalty)
        kept = np.flatnonzero(np.abs(w) > 1e-3)
        return Rules(float(b), [rules[k] for k in kept], [float(w[k]) for k in kept])


def score(docs: DataFrame, rules: Rules, *keep: str) -> DataFrame:
    """doc_id (and the columns `keep`), score, predicted of every document."""
    table = with_statistics(docs, "doc_id", *keep).withColumn("score", rules.column())
    return table.select("doc_id", *keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
