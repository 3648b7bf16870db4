"""Native histograms: against observations counted in plain Python, and small cases worked out by hand."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from seriesforge.api import Api
from seriesforge.model import Grid, QueryError
from seriesforge.operators import histograms
from seriesforge.operators.histograms import HISTOGRAM
from seriesforge.operators.select import Storage
from seriesforge.sources.store import Store
from seriesforge.plans.compiler import compile_query


def made(values, schema=0, zero=0.0):
    """A histogram of observations as a tuple in the order of HISTOGRAM."""
    sides = {1: {}, -1: {}}
    for v in values:
        if abs(v) > zero:
            i = math.ceil(round(math.log2(abs(v)) * 2**schema, 9))
            side = sides[1 if v > 0 else -1]
            side[i] = side.get(i, 0.0) + 1.0
    return (schema, zero, float(sum(abs(v) <= zero for v in values)), float(len(values)), float(sum(values)), sorted(sides[1].items()), sorted(sides[-1].items()))


def storage(spark, rows, **options):
    """rows: (ts_ms, number or histogram, name, job)"""
    plain = [(t, x if isinstance(x, (float, int)) and not isinstance(x, bool) else None, x if isinstance(x, tuple) else None, n, j) for t, x, n, j in rows]
    plain = [(t, None if v is None else float(v), h, n, j) for t, v, h, n, j in plain]
    return Storage(spark.createDataFrame(plain, f"ts_ms bigint, value double, hist {HISTOGRAM}, l___name__ string, l_job string"), **options)


def results(s, text, at=600_000):
    q = compile_query(s, text, Grid.instant(at))
    return sorted(((r["l_job"] if "job" in q.labels else None), r["value"]) for r in q.df.collect())


def found(s, text, at=600_000):
    q = compile_query(s, text, Grid.instant(at))
    rows = q.histograms.df.collect() if q.histograms else []
    plain = lambda v: tuple([tuple(x) for x in y] if isinstance(y, list) else y for y in v)
    return sorted(((r["l_job"] if "job" in q.histograms.labels else None), plain(r["value"])) for r in rows)


def test_sum_of_schemas_is_that_of_all_observations(spark):
    r = random.Random(1)
    parts = [[r.choice((-1, 1)) * 2 ** r.uniform(-6, 9) for _ in range(60)] for _ in range(6)]
    s = storage(spark, [(600_000, made(p, schema=i % 3), "h", f"j{i}") for i, p in enumerate(parts)])
    ((_, h),) = found(s, "sum(h)")
    expected = made([x for p in parts for x in p])
    assert h[:4] == expected[:4] and h[5:] == expected[5:] and h[4] == pytest.approx(expected[4])
    ((_, h),) = found(s, "avg(h) * 6")
    assert h[3] == pytest.approx(360) and [c for _, c in h[5]] == pytest.approx([c for _, c in expected[5]])


def test_wider_zero_swallows_and_grows_to_a_filled_bucket(spark):
    s = storage(spark, [(600_000, made([0.5, 2.5, 20.0]), "h", "a"), (600_000, made([0.1, 30.0], zero=3.0), "h", "b")])
    ((_, h),) = found(s, "sum(h)")
    assert h == (0, 4.0, 3.0, 5.0, pytest.approx(53.1), [(5, 2.0)], [])


def test_quantile_fraction_and_variance(spark):
    values = [0.0, 1.5, 1.5, 3.0, 3.5, 6.0, 100.0, 100.0]
    s = storage(spark, [(600_000, made(values), "h", "a"), (600_000, made([-x for x in values]), "h", "n"), (600_000, 5.0, "h", "f")])
    q = lambda x: dict(results(s, f"histogram_quantile({x}, h)"))
    assert q(0.25)["a"] == pytest.approx(2**0.5)  # the second of 8: halfway through (1, 2] in the exponent
    assert q(0.25)["n"] == pytest.approx(-q(0.75)["a"])
    assert q(1)["a"] == pytest.approx(128) and q(0)["a"] == 0 and q(2)["a"] == math.inf and q(-1)["a"] == -math.inf
    assert math.isnan(q("NaN")["a"])
    share = dict(results(s, "histogram_fraction(2, 4, h)"))
    assert share == {"a": pytest.approx(0.25), "n": 0.0}
    assert dict(results(s, "histogram_fraction(-Inf, +Inf, h)")) == {"a": 1.0, "n": 1.0}
    mean = sum(values) / 8
    middle = [0.0, 2**0.5, 2**0.5, 8**0.5, 8**0.5, 32**0.5, 8192**0.5, 8192**0.5]
    assert dict(results(s, "histogram_stdvar(h)"))["a"] == pytest.approx(sum((x - mean) ** 2 for x in middle) / 8)
    assert dict(results(s, "histogram_stddev(h)"))["a"] == pytest.approx((sum((x - mean) ** 2 for x in middle) / 8) ** 0.5)


def test_empty_histogram(spark):
    s = storage(spark, [(600_000, made([]), "h", "a")])
    for text in ("histogram_quantile(0.5, h)", "histogram_avg(h)", "histogram_fraction(0, 1, h)"):
        assert math.isnan(results(s, text)[0][1])
    assert results(s, "histogram_count(h)") == [("a", 0.0)]


def test_rate_counts_over_a_reset(spark):
    rows = [(t * 60_000, made([2.0] * n + [9.0] * n), "h", "a") for t, n in ((1, 1), (2, 3), (3, 5), (4, 1), (5, 2))]
    s = storage(spark, rows)
    # 5 - 1 before the reset, 1 from nothing at it, 1 more behind it; both buckets alike. Extrapolated to 5 minutes
    ((_, h),) = found(s, "increase(h[5m])", at=300_000)
    # 240 s seen, 60 s before the first sample: less than 1.1 gaps; zero is reached sooner, 240 * 2 / 12 s before
    factor = (240 + 240 * 2 / 12) / 240
    assert [c for _, c in h[5]] == pytest.approx([6 * factor] * 2) and h[3] == pytest.approx(12 * factor)
    ((_, r),) = found(s, "rate(h[5m])", at=300_000)
    assert r[3] == pytest.approx(12 * factor / 300)
    ((_, d),) = found(s, "delta(h[5m])", at=300_000)
    assert d[3] == pytest.approx(2 * (240 + 60) / 240)


@pytest.mark.parametrize(
    ("before", "now", "expected"),
    [
        (made([2.0]), made([2.0, 4.0]), False), (made([2.0, 2.0]), made([2.0, 4.0]), True), (made([2.0] * 2, schema=1), made([2.0, 2.0, 9.0]), False), (made([2.0]), made([2.0, 2.0], schema=1), True),
        (made([1.5, 2.0], schema=3), made([2.0, 8.0, 8.0]), True), (made([-2.0]), made([2.0, 2.0]), True), (made([0.1, 2.0]), made([0.1, 2.0, 2.0], zero=1.0), False), (made([0.1], zero=1.0), made([0.1, 2.0]), True),
    ],
)
def test_reset(spark, before, now, expected):
    df = spark.createDataFrame([(before, now)], f"a {HISTOGRAM}, b {HISTOGRAM}")
    assert df.select(histograms.fell(F.col("b"), F.col("a"))).first()[0] is expected


def test_numbers_and_histograms_do_not_mix(spark):
    s = storage(spark, [(600_000, made([2.0]), "h", "a"), (600_000, 7.0, "h", "f"), (540_000, 3.0, "x", "a"), (600_000, made([4.0, 4.0]), "x", "a")])
    assert results(s, "h") == [("f", 7.0)] and [j for j, _ in found(s, "h")] == ["a"]
    assert results(s, "sum(h)") == [] and found(s, "sum(h)") == []
    assert results(s, "sum by (job) (h)") == [("f", 7.0)] and len(found(s, "sum by (job) (h)")) == 1
    assert results(s, "count(h)") == [(None, 2.0)] and results(s, "max(h)") == [(None, 7.0)]
    assert results(s, "x") == [] and found(s, "x")[0][1][3] == 2.0  # the later sample counts
    assert results(s, "count_over_time(x[5m])") == [("a", 2.0)]
    assert results(s, 'absent(h{job="a"})') == []


def test_arithmetic(spark):
    s = storage(spark, [(600_000, made([2.0, 9.0]), "h", "a"), (600_000, made([2.0]), "g", "a"), (600_000, made([2.0]), "g", "b")])
    assert found(s, "h - g") == [("a", (0, 0.0, 0.0, 1.0, 9.0, [(4, 1.0)], []))]
    assert found(s, "h + on (job) g")[0][1][3] == 3.0
    assert found(s, "-h / 2")[0][1][3:5] == (-1.0, -5.5)
    assert found(s, 'label_replace(g, "job", "z", "job", "a")')[-1][0] == "z"
    assert results(s, "h * h") == [] and compile_query(s, "2 / h", Grid.instant(0)).histograms is None
    with pytest.raises(QueryError):
        compile_query(s, "histogram_count(1)", Grid.instant(0))


def test_empty_tables_and_no_histograms(spark):
    assert found(storage(spark, []), "sum(rate(h[5m]))") == []
    plain = Storage(spark.createDataFrame([(600_000, 1.0, "h", "a")], "ts_ms bigint, value double, l___name__ string, l_job string"))
    assert results(plain, "histogram_count(h)") == [] and compile_query(plain, "h", Grid.instant(0)).histograms is None


def test_stored_and_merged_with_a_later_write(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    plain = spark.createDataFrame([(1000, 5.0, "h", "f")], "ts_ms bigint, value double, l___name__ string, l_job string")
    store.convert(plain, {}, ["p"])
    store.convert(storage(spark, [(2000, made([2.0]), "h", "a"), (2000, 6.0, "h", "f")]).samples, {}, ["q"])
    s = store.open(0, 0, 10_000)
    assert results(s, "h", at=5000) == [("f", 6.0)] and found(s, "h", at=5000) == [("a", made([2.0]))]
    assert results(s, "h", at=1500) == [("f", 5.0)]


def test_api(spark):
    api = Api(storage(spark, [(600_000, made([-3.0, 0.0, 3.0, 3.0]), "h", "a"), (600_000, 7.0, "h", "f")]))
    status, out = api.handle("/api/v1/query", query="h", time="600")
    assert status == 200
    got = {r["metric"]["job"]: r for r in out["data"]["result"]}
    assert got["f"]["value"] == [600.0, "7"] and "value" not in got["a"]
    assert got["a"]["histogram"] == [600.0, {"count": "4", "sum": "3", "buckets": [[1, "-4", "-2", "1"], [3, "0", "0", "1"], [0, "2", "4", "2"]]}]
    status, out = api.handle("/api/v1/query_range", query="h", start="600", end="660", step="60")
    got = {r["metric"]["job"]: r for r in out["data"]["result"]}
    assert len(got["a"]["histograms"]) == 2 and len(got["f"]["values"]) == 2 and "values" not in got["a"]
    json.dumps(out)
