"""The load notation of query fixtures: `metric{label="value"} 1 2 a+bxN _`."""

import re

from seriesforge.model import NAME, column
from seriesforge.operators.select import Storage


def samples(spark, text, interval_s):
    rows, names = [], set()
    for line in text.strip().splitlines():
        m = re.match(r"(\w+)(\{[^}]*\})?\s+(.*)", line.strip())
        labels = dict(re.findall(r'(\w+)="([^"]*)"', m[2] or "")) | {NAME: m[1]}
        names |= set(labels)
        values = []
        for token in m[3].split():
            k = re.fullmatch(r"(-?[\d.e]+)([+-][\d.e]+)x(\d+)", token)
            values += [float(k[1]) + i * float(k[2]) for i in range(int(k[3]) + 1)] if k else [None if token == "_" else float(token)]
        rows += [(i * interval_s * 1000, v, labels) for i, v in enumerate(values) if v is not None]
    names = sorted(names)
    schema = ", ".join(["ts_ms bigint", "value double", *(f"`{column(n)}` string" for n in names)])
    return spark.createDataFrame([(t, v, *(x.get(n) or None for n in names)) for t, v, x in rows], schema)


def storage(spark, text, interval_s=300, **options):
    return Storage(samples(spark, text, interval_s), **options)
