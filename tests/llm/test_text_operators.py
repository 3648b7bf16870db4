"""Rules, classifiers and language-model scores: contract columns by brute force, accuracy, edge cases."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import common, hmm, quality_rules, rule_ensemble, toxicity
from seriesforge.llm.textstats import Texts, counts

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts():
    r = random.Random(1)
    texts = ["", " ", "\n\n", "a", "é\xa0b c", cases.LONG, "x\n x\nx\n\nx"] + ["".join(r.choice(["a ", "b ", "c\n", "é", "# ", "漢|", "  ", "\t"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    got = counts(Texts.of([t.encode() for t in texts]))
    for i, t in enumerate(texts):
        assert tuple(int(got[x][i]) for x in quality_rules.FIELDS) == brute_counts(t), t[:80]


def noisy(i):
    t = cases.prose(i, 80)
    return " ".join(w + ("***" if k % 2 else "$$$") for k, w in enumerate(t.split())) if i % 2 == 0 else t


@pytest.fixture(scope="module")
def labelled(spark):
    docs = cases.documents(spark, [(1000 + i, noisy(i)) for i in range(160)])
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(160)] + [(None, 1), (1001, None)], "doc_id bigint, quality int")
    return docs, labels


def test_quality_rules(spark, labelled):
    docs, labels = labelled
    model = quality_rules.QualityRules(bits=14).fit(docs, labels)
    rows = quality_rules.score(docs, model).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] != 7}
    for i, t in texts.items():
        if i is not None:
            n, chars, symbols, dup, repeat = brute_counts(t or "")
            r = by[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
            assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
            assert r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)
    assert sum(by[1000 + i]["kept"] == bool(i % 2) for i in range(160)) >= 156
    kept = quality_rules.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.score(cases.empty(spark), quality_rules.QualityRules(bits=10).fit(cases.empty(spark), labels)).count() == 0


def test_rule_ensemble(spark, labelled):
    docs, labels = labelled
    rules = rule_ensemble.RuleEnsemble(trees=8).fit(docs, labels, keep=common.fold("doc_id", 3) != 1)
    assert rules.rules and len(rules.describe()) == len(rules.rules)
    rows = rule_ensemble.score(docs, rules).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["doc_id"] and r["doc_id"] >= 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    # the compiled column is the ensemble
    table = rule_ensemble.with_statistics(docs.where("doc_id >= 1000"), "doc_id").withColumn("score", rules.column()).toPandas()
    x = table[rule_ensemble.STATISTICS].to_numpy()
    z = rules.bias + sum(w * rule_ensemble.holds(r, x) for r, w in zip(rules.rules, rules.weights, strict=True))
    assert np.allclose(1 / (1 + np.exp(-z)), table["score"])
    assert rule_ensemble.RuleEnsemble().fit(docs, labels.where("false")).column() is not None


def brute_statistics(text):
    words = [w for w in re.split("[ \\t-\\r]+", text) if w]
    n_words, chars, symbols, dup, repeat = brute_counts(text)
    raw, n, lines = text.encode(), max(n_words, 1), text.count("\n") + 1
    size, per = max(len(raw), 1), Counter(words)
    return {
        "words": n_words, "mean_word": chars / n, "symbol_rate": symbols / size, "marked_words": sum(bool(re.search(r"[#*$%&|<>]", w)) for w in words) / n, "dup_lines": dup / lines, "repeats": repeat / n,
        "distinct": len(per) / n, "same_next": sum(a == b for a, b in zip(words, words[1:])) / n, "digit_rate": len(re.findall("[0-9]", text)) / size, "upper_rate": len(re.findall("[A-Z]", text)) / size,
        "punct_rate": len(re.findall(r"[!-/:-@\[-`{-~]", text)) / size, "line_words": n_words / lines, "top_word": max(per.values(), default=0) / n, "short_words": sum(len(w.encode()) <= 2 for w in words) / n,
        "wide_rate": len(re.findall("[^\\x00-\\x7f]", text)) / size, "longest_word": max((len(w.encode()) for w in words), default=0), "space_rate": len(re.findall("[ \\t-\\r]", text)) / size,
    }


def test_statistics_by_counting():
    r = random.Random(5)
    texts = ["", " ", "one", "a a a b", cases.prose(3, 80), "Grüße — 漢字 😀 é\n\nGrüße — 漢字 😀 é", cases.LONG[:9000]]
    texts += ["".join(r.choice(["ab", "C", " ", "\n", "#", "7", ".", "é", "漢", "|", "\t"]) for _ in range(r.randint(1, 200))) for _ in range(60)]
    for text, row in zip(texts, rule_ensemble.statistics([x.encode() for x in texts]), strict=True):
        assert dict(zip(rule_ensemble.STATISTICS, row, strict=True)) == pytest.approx(brute_statistics(text)), text


def test_lasso_is_optimal():
    """No weight can be moved to a lower loss: its gradient balances the penalty, or is smaller where it is zero."""
    random = np.random.default_rng(3)
    x = (random.random((300, 12)) < 0.4).astype(float)
    y = (random.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] - 0.5)))).astype(float)
    share, penalty = np.full(300, 1 / 300), 0.01
    w, b = rule_ensemble.lasso(x, y, share, penalty, steps=6000)
    error = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
    gradient = x.T @ error
    assert abs(error.sum()) < 1e-5 and w[0] > 0.5 and w[1] < -0.5 and (w == 0).any()
    assert np.allclose(gradient[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(gradient[w == 0]) <= penalty + 1e-5).all()


def test_characters_are_code_points_and_equal_runs_share_slots():
    texts = ["aé漢😀aé漢😀", "", "漢字", "ascii only", "😀"]
    t = Texts.of([x.encode() for x in texts])
    letters, doc = quality_rules.characters(t)
    flat = [(i, c) for i, x in enumerate(texts) for c in x + " "]
    assert doc.tolist() == [i for i, _ in flat]
    names = {}
    assert all(names.setdefault(c, v) == v for (_, c), v in zip(flat, letters.tolist(), strict=True)) and len(set(names.values())) == len(names)
    for family, order in ((2, 3), (3, 4)):
        slot, owner = quality_rules.hashed(t, 40)[family]
        runs = [(i, (x + " ")[k : k + order]) for i, x in enumerate(texts) for k in range(len(x) + 2 - order)]
        assert owner.tolist() == [i for i, _ in runs]
        of = {}
        assert all(of.setdefault(run, s) == s for (_, run), s in zip(runs, slot.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_calibration_is_optimal():
    random = np.random.default_rng(4)
    z = random.normal(size=400)
    y = (random.random(400) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    a, b = quality_rules.calibrate(z, y)
    error = quality_rules.sigmoid(a * z + b) - np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    assert abs((error * z).sum() + 1e-3 * (a - 1)) < 1e-6 and abs(error.sum()) < 1e-6 and 1 < a < 3


def test_maximal_segments():
    def brute(s):
        """Recursively: the largest segment (shortest, leftmost), then the two sides."""
        best = max(((sum(s[i : j + 1]), -(j - i), -i) for i in range(len(s)) for j in range(i, len(s))), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(s[:i]) + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in brute(s[j + 1 :])]

    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute(s)


def test_toxicity(spark):
    bad = ["vile", "scoundrel", "wretch"]
    r = random.Random(3)

    def text(i):
        words = cases.prose(500 + i, 60).split()
        if i % 4 == 0:
            for k in range(8):
                words.insert(30, bad[(i + k) % 3])
        return " ".join(words)

    docs = cases.documents(spark, [(1000 + i, text(i)) for i in range(240)])
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i in range(240)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    operator = toxicity.ToxicPassages()
    for some in (operator, toxicity.ToxicPassages(broadcast_rows=0)):
        model = some.fit(docs, labels, keep=common.fold("doc_id", 5) != 0)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        right = [r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows if r["doc_id"] and r["doc_id"] >= 1000]
        assert sum(right) >= 0.98 * len(right)
    found = toxicity.passages(docs, model).where("doc_id = 1000").collect()
    assert found and any(w in found[0]["passage"] for w in bad)
    assert operator.fit(cases.empty(spark), labels.where("false")).base == 0.5
    assert toxicity.score(cases.empty(spark), model).count() == 0 and r


def test_toxicity_keeps_every_word_that_counts(spark):
    # 23,000 words that shun toxic texts outrank one that only six toxic texts have
    shy = " ".join("q" + "".join("abcdefghij"[i // 10**k % 10] for k in range(5)) for i in range(23_000))
    text = lambda i: f"nothing {'vilest ' * 6}here" if i < 48 and i % 8 == 0 else f"nothing {shy} here" if i % 2 else "nothing here"
    docs = spark.createDataFrame([(i, text(i)) for i in range(640)], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(640)], "doc_id bigint, toxic int")
    results = []
    for options in ({}, {"broadcast_words": 5}):
        model = toxicity.ToxicPassages(**options).fit(docs, labels)
        found = toxicity.passages(docs, model).where("passage like '%vilest%'").select("doc_id").distinct().collect()
        assert {r["doc_id"] for r in found} == {0, 8, 16, 24, 32, 40}
        assert (model.table is not None) == bool(options)
        results.append(sorted(map(tuple, toxicity.score(docs, model).collect())))
    assert [r[0] for r in results[0]] == list(range(640)) and np.allclose(*([r[1] for r in x] for x in results))


def test_hidden_markov(spark):
    docs = cases.documents(spark, [(1000 + i, ("ja nein doch " if i % 2 else "yes no maybe ") * 20) for i in range(60)])
    rows = hmm.HiddenMarkov(states=4, max_words=200, tails=3, rounds=6).score(docs, common.fold("doc_id", 5) == 1).collect()
    assert len(rows) == docs.count()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 5
    tokens = [(r["doc_id"], [w.lower() for w in WORD.findall(r["text"] or "")] + [None]) for r in docs.collect()]
    c = Counter(w for i, t in tokens if fold(i) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), fold(i) == 1, len(t), sum(c[w] > 0 for w in t), n), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens)
    got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"]) for r in rows)
    assert [a for a, _ in got] == [a for a, _ in want]
    assert np.allclose([b for _, b in got], [b for _, b in want])
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 5
    nothing = hmm.HiddenMarkov().score(docs, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in nothing} == {(0, 0, 0.0, 0.0)}
    assert hmm.HiddenMarkov().score(cases.empty(spark), F.lit(False)).count() == 0


def test_forward_and_expectations_by_enumeration():
    rng = np.random.default_rng(0)
    k, classes = 3, 5
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), np.ascontiguousarray(norm(rng.random((k, classes))).T))
    seqs = [rng.integers(0, classes, n) for n in (1, 4, 2, 5)]
    import itertools

    total, emit, step = [], np.zeros((k, classes)), np.zeros((k, k))
    for s in seqs:
        paths = {p: m.start[p[0]] * math.prod(m.step[a][b] for a, b in itertools.pairwise(p)) * math.prod(m.emit[x][q] for x, q in zip(s, p, strict=True)) for p in itertools.product(range(k), repeat=len(s))}
        z = sum(paths.values())
        total.append(math.log10(z))
        for p, w in paths.items():
            for x, q in zip(s, p, strict=True):
                emit[q, x] += w / z
            for a, b in itertools.pairwise(p):
                step[a, b] += w / z
    got = hmm.forward(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
    assert np.allclose(got, total)
    e = hmm.Expected(m, most=6)
    e.add(seqs)
    assert np.allclose(e.emit, emit, atol=1e-4) and np.allclose(e.step, step, atol=1e-4) and abs(e.loss - sum(total)) < 1e-4


def test_expectations_of_long_texts():
    """Whole texts, longer than a batch holds, against a plain forward-backward recursion."""
    rng = np.random.default_rng(1)
    k, classes = 4, 9
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k)) ** 4), np.ascontiguousarray(norm(rng.random((k, classes)) ** 3).T))
    seqs = [rng.integers(0, classes, n) for n in (1500, 700, 3, 701)]
    emit, step, start, loss = np.zeros((k, classes)), np.zeros((k, k)), np.zeros(k), 0.0
    for s in seqs:
        a, b, c = np.zeros((len(s), k)), np.ones((len(s), k)), np.zeros(len(s))
        for t, x in enumerate(s):
            a[t] = m.emit[x] * (a[t - 1] @ m.step if t else m.start)
            c[t] = a[t].sum()
            a[t] /= c[t]
        for t in range(len(s) - 2, -1, -1):
            b[t] = m.step @ (m.emit[s[t + 1]] * b[t + 1]) / c[t + 1]
            step += np.outer(a[t], m.emit[s[t + 1]] * b[t + 1] / c[t + 1]) * m.step
        for t, x in enumerate(s):
            emit[:, x] += a[t] * b[t]
        start += a[0] * b[0]
        loss += np.log10(c).sum()
    for most in (10**6, 800):
        e = hmm.Expected(m, most)
        e.add(seqs)
        assert np.allclose(e.emit, emit, rtol=1e-3) and np.allclose(e.step, step, rtol=1e-3) and np.allclose(e.start, start, atol=1e-3)
        assert e.n == sum(map(len, seqs)) and abs(e.loss - loss) < 1e-2


def plain_expectations(m, seqs, most):
    """As Expected did it: sequences' steps together, in batches of at most `most` tokens, longest first; emissions' and steps' counts."""
    emit32, step32, start32 = (x.astype(np.float32) for x in (m.emit, m.step, m.start))
    emit, step = np.zeros((len(m.step), len(m.emit))), np.zeros_like(m.step)
    seqs = sorted(seqs, key=len, reverse=True)
    while seqs:
        sizes = np.array([len(x) for x in seqs])
        sizes = sizes[: max(1, np.searchsorted(np.cumsum(sizes), most, "right"))]
        some, seqs = seqs[: len(sizes)], seqs[len(sizes) :]
        alphas, scales, at = [], [], [np.array([x[t] for x in some[: np.searchsorted(-sizes, -t - 1, "right")]]) for t in range(sizes[0])]
        began = time.process_time()
        for ids in at:
            x = emit32[ids]
            x *= alphas[-1][: len(ids)] @ step32 if alphas else start32
            scales.append(x.sum(axis=1))
            alphas.append(x / scales[-1][:, None])
        beta, moved = np.ones_like(alphas[-1]), np.zeros_like(step)
        for t in range(len(at) - 1, 0, -1):
            n = len(at[t])
            x = emit32[at[t]] * beta / scales[t][:, None]
            moved += alphas[t - 1][:n].T @ x
            alphas[t] *= beta
            beta = np.concatenate([x @ step32.T, np.ones((len(at[t - 1]) - n, len(step)), np.float32)])
        alphas[0] *= beta
        step += moved * m.step
        ids, alpha = np.concatenate(at), np.concatenate(alphas)
        for k in range(len(step)):
            emit[k] += np.bincount(ids, alpha[:, k], len(m.emit))
        plain_expectations.took += time.process_time() - began
    return emit, step


@pytest.mark.parametrize("k", [16, 5])
def test_expectations_are_fast_and_those_of_a_plain_recursion(k):
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k)) ** 4), np.ascontiguousarray(norm(rng.random((k, 50_000)) ** 3).T))
    seqs = [rng.integers(0, 50_000, int(n)) for n in np.minimum(rng.lognormal(5.6, 1, 2500) + 1, 6000)]
    ratios = []
    for _ in range(3):
        plain_expectations.took = 0.0
        emit, step = plain_expectations(m, seqs, 400_000)
        e, began = hmm.Expected(m), time.process_time()
        e.add(seqs)
        ratios.append((time.process_time() - began) / plain_expectations.took)
        assert np.allclose(e.emit, emit, rtol=1e-3, atol=1e-5) and np.allclose(e.step, step, rtol=1e-3) and abs(e.emit.sum() - e.n) < 1e-3 * e.n
    assert k != 16 or min(ratios) < 0.8, ratios


def test_likelihood_rises_and_probabilities_add_up(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'ab'[i % 2]}{(i * k) % (20 + i % 3)}" for k in range(60))) for i in range(90)], "doc_id bigint, text string").repartition(70)
    h = hmm.HiddenMarkov(states=3, max_words=12, tails=2)
    seen, orig = [], h.round

    def round_(coded, model, base):
        seen.append((orig(coded, model, base), base))
        return seen[-1][0]

    h.round = round_
    # one-word documents with every word, seen or not, and the texts' ends
    words = sorted({w for r in docs.collect() for w in r["text"].split()})
    h.score(docs, F.lit(False)).count()
    losses = [x[1] for x, _ in seen]
    assert len(losses) > 2 and all(b > a - 1e-4 for a, b in zip(losses, losses[1:], strict=False))
    (model, _), base = seen[-1]
    assert abs(base.sum() - 1) < 1e-9 and np.allclose(model.emit.sum(axis=0), 1) and len(words) > 12
    # a tie at the level that does not fit whole still leaves a vocabulary
    ties = spark.createDataFrame([(bytes([97 + i // 26, 97 + i % 26]), 5) for i in range(300)], "word binary, n bigint")
    assert 150 < len(hmm.HiddenMarkov(max_words=200)._top(ties)) <= 200
