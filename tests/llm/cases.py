"""Small tables with what operators must bear: nulls, empty and long texts, repeated rows, ties, clashing columns."""

import random

LONG = " ".join(f"w{i % 997}x" for i in range(30_000))
EXTRA = "score double, h bigint, uid bigint, oid bigint, copies bigint, size bigint, k bigint, spans string, label int, held_out boolean, fp bigint, n bigint, words double"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, extra=()):
    texts = [prose(i, 60 + 7 * i) for i in range(24)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, LONG), (104, texts[3]), (105, texts[3] + " one more tail"), (106, "Grüße — 漢字 😀 é"), (None, texts[5]), (None, None), (7, texts[7]), (7, texts[7]), (7, "another text under a used id"), (-5, texts[2][10:])]
    rows += list(extra)
    source = lambda i: None if i is None or i % 7 == 0 else f"s{i % 3}"
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t), 1.0, 1, 1, 1, 1, 1, 1, "x", 1, True, 1, 1, 1.0) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, column="quality", ids=range(24)):
    rows = [(i, i % 2) for i in ids] + [(None, 1), (3, None), (4, 0), (4, 0)]
    return spark.createDataFrame(rows, f"doc_id bigint, {column} int")


def key(r):
    return str(tuple(r))
