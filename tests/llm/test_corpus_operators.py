"""Token files, packing, mixing, deduplication, pipeline: exact round trips and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesforge.llm import common, components, embedding_dedup, induced_sort, mixing, packing, simhash, suffix_dedup, token_files
from seriesforge.llm.tokens import Encoder

from . import cases


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    r = random.Random(4)
    pieces = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\xa0", "\x1c", "'s", "'S", "’", "12", "½", "²", "İ", "Σ", "ΑΣ", "漢", "!", "--", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|end", "oftext|>", "_", "\r\n", " x", "ª", "Ā", "😀", "\0", "foo", "'ll", "'", ","]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [cases.LONG[:20_000]]
    e, one = Encoder(public_tokenizers.path(name), most=50), whole(name)
    for some in (texts[:700], texts[700:]):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([t.encode() for t in some])] == [one(t) for t in some]


def test_encoder_merges_words_itself():
    """no word of letters, digits or marks goes through the library, which takes three times as long."""
    name = "byte_bpe_50k.json"
    e, one = Encoder(public_tokenizers.path(name)), whole(name)
    texts = [cases.prose(3, 400), "Größe été, señor!! New line (2024): café; Привет w3x ... a_b", ""]
    want = [one(x) for x in texts]
    e.tokenizer = type("Idle", (), {"encode_batch": staticmethod(lambda texts, **_: [None for _ in texts if pytest.fail(f"the library was given {texts}")])})
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([x.encode() for x in texts])] == want


def test_encoder_cuts():
    """Chunks end where units end, whatever stands around: white space of all kinds, apostrophes, letters beyond ASCII."""
    name = "byte_bpe_50k.json"
    e, one = Encoder(public_tokenizers.path(name), most=200), whole(name)
    r = random.Random(11)
    pieces = [*"aZ0!'_ \n\t\r\0\x1f\x7f", "'s", "'ll", "'re", "  ", "\xa0", "\x85", " ", "᠎", " ", " ", " ", " ", "　", "​", "’", "…", "é", "×", "÷", "ß", "ɏ", "ɐ", "Ж", "漢", "́", "²", "٣", "Ⅷ", "😀", "�", "<|endoftext|>", "the", " and", "----"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    for some in (texts[:15_000], texts[15_000:]):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([t.encode() for t in some])] == [one(t) for t in some]
    broken = [b"a\xc3 b", b"x\xe2\x80 \xff\xc3\xa9,z", b"\x80\x85 a", b"\xa0\n\xf0\x9f b"]
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(broken)] == [one(x.decode("utf-8", "replace")) for x in broken]
    assert max(map(len, e.known | e.old)) <= 64


def test_encoder_of_unreachable_entries(tmp_path):
    """A vocabulary with an entry that its own merges do not reach is left to the library."""
    from tokenizers import models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("b", "c"), ("a", "b"), ("ab", "c")]
    t = Tokenizer(models.BPE(vocab={x: i for i, x in enumerate([*letters, "bc", "ab", "abc"])}, merges=merges))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    assert e.kind == "spaced" and e.merge is None and Encoder(public_tokenizers.path("byte_bpe_50k.json")).merge
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode([b"abc xabcab"])] == [t.encode("abc xabcab").ids]


def test_token_files(spark, tmp_path):
    docs = cases.documents(spark)
    path, one = f"file://{tmp_path}/t", whole("byte_bpe_50k.json")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], (r["text"] or "").encode()))
    want, at = [], 0
    for r in order:
        ids = one(r["text"]) + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.digest(spark, path).collect()), key=lambda r: r[1]) == want
    assert sorted(r["start"] for r in token_files.metadata(spark, path).collect()) == [w[1] for w in want]
    assert "ids" not in token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert token_files.tokens(spark, path, 103, 103).first()["ids"] == one(cases.LONG) + [0]
    token_files.write(cases.empty(spark), path + "0", public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_files.digest(spark, path + "0").count() == 0


def test_differencing():
    r = random.Random(5)
    for n, m in ((1, 1), (3, 5), (40, 6), (300, 20)):
        x = [r.randint(1, 1000) for _ in range(n)]
        found = packing.differenced(x, m)
        assert sorted(i for _, w in found for i in w) == list(range(n)) and all(s == sum(x[i] for i in w) for s, w in found) and len(found) <= m
    sums = [s for s, _ in found]
    assert max(sums) - min(sums) < 30
    assert len(packing.packed([3, 3, 3], 5)) == 3  # two windows of 5 do not hold them
    assert packing.packed([], 5) == []


def test_packing(spark):
    docs, one = cases.documents(spark), whole("word_bpe_49k.json")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(one(r["text"]) + [2])
    sequences, got = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: sum(map(len, x)) for i, x in want.items()}
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in want[r["doc_id"]])
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(cases.empty(spark), public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


def test_mixing(spark):
    docs = cases.documents(spark, [(1000 + i, cases.prose(i, 20 + i)) for i in range(120)])
    assert mixing.mixture(docs).count() == docs.count()
    docs = docs.where("doc_id is null or doc_id <> 103")  # whole copies of one very long text cannot meet a small source's target
    rows = mixing.mixture(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert len(rows) == docs.count()
    sizes, took, target = {}, {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
        left -= sum(3.0 * sizes[s] for s in over)
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(took[s] - want[s]) <= max(40, 0.01 * want[s])
    assert sorted(map(tuple, mixing.mixture(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    mixed = mixing.taken(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy().agg(F.sum(mixing.size())).first()[0] == sum(took.values())
    assert mixing.mixture(cases.empty(spark)).count() == 0 == mixing.taken(cases.empty(spark)).count()


@pytest.mark.parametrize(("names", "weights", "share"), [("ab", (5, 2), 2.5), ("ba", (33, 2), 0.2)])
def test_mixing_with_few_very_long_texts(spark, names, weights, share):
    rows = [(i, names[0], "w " * (20 if i < 5000 else 20_000)) for i in range(5005)]
    rows += [(10_000 + i, names[1], "w " * 1000) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    took = mixing.mixture(docs, weights).where("doc_id < 10000").agg(F.sum("taken"), F.max("target")).first()
    assert took[0] == pytest.approx(took[1], abs=20) and took[1] == pytest.approx(share * 200_000)


def test_tilts():
    rng = np.random.default_rng(3)
    for size, n in (([200, 200_000], [5000, 5]), ([50, 100, 200_000], [5000, 5000, 2]), ([300, 3_000_000], [100_000, 1]), (np.unique(rng.integers(1, 10**7, 50)), 1), ([1], [1])):
        size = np.array(size, float)
        mass = size * n
        for share in (1e-6, 0.2, 0.999, 1, 1.001, 2.5, 2.9, 2.9999, 3):
            w = mixing.rate(mixing.solved(size, mass, share * mass.sum(), 3), size, 3)
            assert mass @ w == pytest.approx(share * mass.sum(), rel=1e-8)


def test_components(spark):
    r = random.Random(6)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (9999, 9999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = components.connected(spark.createDataFrame([*links, (None, 1)], "x bigint, y bigint").repartition(5))
    assert {x["id"]: x["root"] for x in found.collect()} == {x: find(x) for x in parent}
    assert components.connected(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
    with pytest.raises(ArithmeticError):
        components.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "x bigint, y bigint").repartition(20), rounds=1)


def test_hub_links_are_split(spark):
    hub = spark.createDataFrame([(1, i) for i in range(2, 2000)], "a bigint, b bigint")
    out = components.with_least(hub)
    assert out.count() == 1998 and out.select("m").distinct().collect() == [(2,)]
    plan = out._jdf.queryExecution().toString()
    assert "Join Inner, ((a" in plan and "salt" in plan


def test_blocks_follow_rows_and_tasks():
    assert embedding_dedup.dealt(100, 6, 8192) == 1 and embedding_dedup.dealt(10_256, 6, 8192) == 7 and embedding_dedup.dealt(10**7, 6, 8192) == 1221
    n = embedding_dedup.dealt(10**7, 4000, 8192)
    assert n * (n + 1) // 2 >= 4 * 4000


def test_golay_keys():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500).astype(np.uint64)
    near = fp.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (set(zip(*(x.tolist() for x in simhash.fuzzy_keys(f)), strict=True)) for f in (fp, near))
    assert {r for _, r in a & b} == set(range(500))


def test_simhash(spark):
    base = cases.prose(77, 200).split()
    r = random.Random(8)
    copies = []
    for i in range(40):
        words = list(base)
        words[r.randrange(len(words))] = "changed"
        copies.append((2000 + i, " ".join(words)))
    docs = cases.documents(spark, copies)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = sorted((str(r["doc_id"]), f"{brute(r['text']):016x}") for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == prints
    fp = sorted({int(p, 16) for _, p in prints})
    root = {x: x for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fp):
        for b in fp[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            c = find(int(r["fingerprint"], 16))
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(find(int(r["fingerprint"], 16))) for r in rows)
    # crowded keys in tiles give the same links
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp], "fp bigint")
    one, two = ({(x["id"], x["root"]) for x in components.connected(simhash.links(distinct, 4, tile)).collect()} for tile in (2048, 3))
    assert one == two and one
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(least.get(c)) for c in {find(int(p, 16)) for _, p in prints})
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_one_row_per_component(spark):
    a, b, c, d, e = (cases.prose(600 + i, 80) for i in range(5))
    near = lambda x: x + " "  # noqa: E731  the same fingerprint
    docs = cases.documents(spark).where("false")
    rows = [(None, a), (None, near(a)), (None, b), (None, b), (None, c), (7, d), (7, d), (7, near(d)), (7, e), (3, near(e)), (9, c), (8, cases.prose(700, 80)), (8, cases.prose(701, 80))]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"].strip()) for r in kept.collect()), key=str)
    assert found == sorted([(None, a), (None, b), (9, c), (7, d), (3, e.strip()), (8, cases.prose(700, 80)), (8, cases.prose(701, 80))], key=str)


def test_suffix_order():
    r = random.Random(9)
    for it in range(400):
        t = [r.randint(0, r.choice([1, 2, 4])) for _ in range(r.randint(1, 40))]
        depth = r.choice([3, 5, 100])
        a, shared = induced_sort.suffix_order(np.array(t), depth, 1 << 30 if it % 2 else 64)
        key = lambda i: t[i : i + depth]  # noqa: B023, E731
        assert sorted(a.tolist()) == list(range(len(t))) and [key(i) for i in a] == sorted(key(i) for i in range(len(t)))
        for k in range(1, len(t)):
            x, y = key(a[k - 1]), key(a[k])
            assert shared[k] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_suffix_order_in_small_steps(monkeypatch):
    r = random.Random(10)
    for it in range(150):
        t = np.array([r.randint(0, r.choice([1, 2, 200])) for _ in range(r.randint(1, 150))] * r.choice([1, 1, 3]))
        depth = r.choice([5, 100])
        want = induced_sort.suffix_order(t, depth)
        with monkeypatch.context() as m:
            m.setattr(induced_sort, "AT_ONCE", r.choice([1, 7, 40]))
            got = induced_sort.suffix_order(t, depth, 64 if it % 2 else 1 << 30)
        assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))
        key = lambda i: t[i : i + depth].tolist()  # noqa: B023, E731
        assert [key(i) for i in got[0]] == sorted(key(i) for i in range(len(t)))


def test_suffix_sort_memory():
    """Two tasks of an executor sort shards of 8 MB at once: at most 32 bytes for each byte of text."""
    import tracemalloc

    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    text = b" ".join(words[i] for i in rng.integers(0, len(words), 320_000))
    bodies = [text[i : i + 170] for i in range(0, len(text), 170)]
    bodies = [x for x in bodies if len(x) >= 100] + bodies[:50]
    tracemalloc.start()
    try:
        spans = suffix_dedup.repeated(np.arange(len(bodies)), np.zeros(len(bodies), np.int64), bodies, 100)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x.tolist() for x in spans] == [list(range(len(bodies) - 50, len(bodies))), [0] * 50, [170] * 50]
    assert peak < 32 * sum(map(len, bodies)), peak / sum(map(len, bodies))


def test_shards_stay_within_their_size(monkeypatch):
    import pyarrow as pa

    sizes, real = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    monkeypatch.setattr(suffix_dedup, "repeated", lambda oid, first, bodies, width: sizes.append(sum(map(len, bodies))) or real(oid, first, bodies, width))
    body = [hashlib.sha512(bytes([k // 2 % 256])).hexdigest().encode() for k in range(100)]  # 128 bytes, each twice in a row
    columns = [pa.array([k // 2 for k in range(100)], pa.int64()), pa.array(range(100), pa.int64()), pa.array([0] * 100, pa.int64()), pa.array(body, pa.binary())]
    rows = pa.RecordBatch.from_arrays(columns, ["key", "oid", "first", "body"])
    out = [x for b in suffix_dedup._sorted(iter([rows.slice(i, 20) for i in range(0, 100, 20)]), 100) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(out) == [(k, 0, 128) for k in range(1, 100, 2)]
    assert sum(sizes) == 12_800 and max(sizes) <= 4000


def removal(rows, width):
    """Brute force over (doc_id, text) in order; equal rows are one document."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                mark[k : k + width] = True
            seen.add(b[k : k + width])
        left = bytes(np.frombuffer(b, np.uint8)[~mark])
        out[i, t or ""] = (len(b), int(mark.sum()), int((np.diff(mark.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest(), left)
    return out


def test_suffix_dedup(spark):
    passage = cases.prose(88, 30)
    extra = [(3000 + i, cases.prose(900 + i, 20) + passage + cases.prose(950 + i, 20)) for i in range(12)] + [(3100, "-" * 700), (3101, "ab" * 300), (3102, "é" * 400), (3103, passage[:99])]
    docs = cases.documents(spark, extra).where("doc_id is null or doc_id <> 7").where("doc_id is not null or text is not null")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = removal(rows, 100)
    for crowd in (4096, 2, 0):
        got = suffix_dedup.spans(docs, 100, crowd).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *want[i, t or ""][:4]) for i, t in rows), key=str)
    left = suffix_dedup.without_repeats(docs, 100)
    assert left.columns == docs.columns
    texts = {(r["doc_id"], r["text"] or "") for r in left.collect()}
    assert texts == {(i, want[i, t or ""][4].decode("utf-8", "ignore")) for i, t in rows}
    # repeated ids: equal rows are one document
    twice = docs.unionByName(docs.where("doc_id = 3"))
    assert {tuple(r) for r in suffix_dedup.spans(twice, 100).where("doc_id = 3").collect()} == {(3, *want[3, dict(rows)[3]][:4])}
    assert suffix_dedup.spans(cases.empty(spark)).count() == 0 == suffix_dedup.without_repeats(cases.empty(spark)).count()


@pytest.mark.parametrize("width", [23, 256])
def test_widths_that_do_not_fit_are_refused(spark, width):
    for f in (suffix_dedup.spans, suffix_dedup.without_repeats):
        with pytest.raises(ValueError, match="width"):
            f(cases.empty(spark), width=width)


def test_segments_do_not_depend_on_slices():
    r = random.Random(12)
    texts = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 3000))) for _ in range(30)]
    texts += [texts[3][50:900] * 3, b"x" * 2000]

    def windows(piece, together):
        anchors = {}
        for i in range(0, len(texts), together):
            h, _, doc, first, ahead, more = suffix_dedup.segments(texts[i : i + together], 100, piece)
            for k in range(len(h)):
                for j in range(more[k] + 1):
                    assert anchors.setdefault((i + int(doc[k]), int(first[k]) + j), (int(h[k]), int(first[k] + ahead[k]))) == (int(h[k]), int(first[k] + ahead[k]))
        return anchors

    want = windows(1 << 20, 32)
    assert want == windows(700, 32) == windows(1 << 20, 1) and len(want) == sum(max(0, len(t) - 99) for t in texts)


def test_crowded_anchors(spark):
    """A fixed string of 150 bytes, then fields that vary, some of them twice; batches end inside anchors."""
    fixed = cases.prose(5, 40)[:150]
    rows = [(i, cases.prose(3000 + i, 15) + fixed + f"{i // 2 if i % 10 == 0 else i:08d}" * 3 + cases.prose(6000 + i, 15)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = removal(rows, 100)
    for crowd in (4096, 50):
        got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.spans(docs, 100, crowd).collect()}
        assert got == {(i, *want[i, t][:4]) for i, t in rows}
    with pytest.raises(ValueError):
        suffix_dedup.spans(docs, 20)


def test_texts_travel_once_to_segments_and_once_to_spans(spark, monkeypatch):
    """Crowded anchors and others, with and without crowded parts: one step that fetches segments, two exchanges of texts."""
    fixed = cases.prose(5, 40)[:150]
    rows = [(i, cases.prose(3000 + i, 15) + fixed + cases.prose(7000 + i // 2, 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, staged = removal(rows, 100), common.staged
    for crowd in (4096, 50, 5):
        plans = []
        monkeypatch.setattr(common, "staged", lambda df, name, **options: plans.append(df) or staged(df, name, **options))
        got = suffix_dedup.spans(docs, 100, crowd)
        plans = [str(x._jdf.queryExecution().sparkPlan()) for x in [*plans, got]]
        assert sum(len(re.findall(r"MapInArrow[^\n]*asks#", x)) for x in plans) == 1
        assert sum(len(re.findall(r"Join \[oid#", x)) for x in plans) == 2
        assert {tuple(r) for r in got.collect()} == {(i, *want[i, t][:4]) for i, t in rows}


def test_judgements_of_cut_anchors():
    import pyarrow as pa

    r = random.Random(13)
    rows = sorted((h, c, r.randint(0, 50), r.randint(0, 99) << 16 | 3 << 8 | 5) for h in range(6) for c in range(1, r.choice([2, 9, 60])) for _ in range(r.randint(1, 4)))
    names = ["h", "c", "oid", "at"]

    def judge(size, most):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size], strict=True)], names) for i in range(0, len(rows), size)]
        asks, marks = set(), set()
        for b in suffix_dedup._judged(iter(batches), 100, 5, most):
            for h, oid, start, end in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if h is None:
                    marks |= {(oid, k) for k in range(start, end)}
                else:
                    asks.add((h, oid, start, end))
        return asks, marks

    asks, marks = judge(10**6, 10**6)
    for size in (7, 25):
        some, same = judge(size, 20)
        assert same == marks and {x[:3] for x in asks} <= {x[:3] for x in some}
        assert all(len({x[3] for x in some if x[0] == h}) <= 1 for h in range(6))


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base[:10] + 0.1 * rng.normal(size=(10, 16)), base[:5], 3 * base[5:8], base[:1] + 0.35 * rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] + [1.0] * 15, 1), (504, [None] + [1.0] * 15, 1), (505, [float("inf")] * 16, 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (None, v[0].tolist(), 1), (3, v[3].tolist(), 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, n bigint")
    for block in (8192, 16):
        got = sorted(map(tuple, embedding_dedup.near_duplicates(df, block=block).collect()), key=str)
        everything = rows + odd
        good = [x is not None and len(x) > 0 and all(y is not None and np.isfinite(y) for y in x) and any(x) for _, x, _ in everything]
        link = [[b for b in range(len(everything)) if b != a and good[a] and good[b] and len(everything[a][1]) == len(everything[b][1]) and np.dot(np.array(everything[a][1], float), np.array(everything[b][1], float)) / (np.linalg.norm(np.array(everything[a][1], float)) * np.linalg.norm(np.array(everything[b][1], float))) >= 0.9] for a in range(len(everything))]
        want = []
        for a, (i, _, _) in enumerate(everything):
            reach, front = {a}, [a]
            while front:
                for b in link[front.pop()]:
                    if b not in reach:
                        reach.add(b)
                        front.append(b)
            least = min((everything[b][0] for b in reach if everything[b][0] is not None), default=None)
            want.append((i, len(link[a]), least, i == least))
        assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.staged(stage(spark, now, sf_dir), "test-stage")
        if name != "packing":
            assert now.columns == columns and now.count() > 0
        if name in ("quality rules", "near-duplicates"):
            assert now.count() < before.count() and now.join(before, columns, "left_anti").count() == 0
        if name == "repeats":
            want = removal([(r["doc_id"], r["text"]) for r in before.collect()], 100)
            assert {(r["doc_id"], r["text"]) for r in now.collect()} == {(i, x[4].decode("utf-8", "ignore")) for (i, _), x in want.items()}
    assert now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == now.count()
