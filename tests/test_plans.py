import math
import random

import pytest

from seriesforge.model import Grid, QueryError
from seriesforge.operators import windows
from seriesforge.plans.compiler import compile_query
from seriesforge.plans.parser import Aggregate, Binary, Number, Selector, Subquery, duration_ms, parse

from seriesforge.operators.select import Storage

from .load import storage

HTTP = """
http_requests{job="api",instance="0",group="production"} 0+10x10
http_requests{job="api",instance="1",group="production"} 0+20x10
http_requests{job="api",instance="0",group="canary"} 0+30x10
http_requests{job="app",instance="0",group="production"} 0+50x10
http_requests{job="app",instance="1",group="canary"} 0+80x10
foo{job="api",instance="0"} 0+1x10
h_bucket{le="1"} 0+1x10
h_bucket{le="2"} 0+3x10
h_bucket{le="+Inf"} 0+4x10
edge{point="a"} 2+0x10
edge{point="b"} 8+0x10
edge{point="n"} NaN NaN NaN NaN NaN NaN NaN NaN NaN NaN NaN
"""


def test_parse():
    assert parse("1 + 2 * 3 ^ 2 ^ 1") == Binary("+", Number(1), Binary("*", Number(2), Binary("^", Number(3), Binary("^", Number(2), Number(1)))))
    assert isinstance(parse('sum by (a, b,) (x{c=~"d"})'), Aggregate)
    assert parse("x[5m] offset 1m").window == 300_000
    assert isinstance(parse("max_over_time(rate(x[5m])[1h:30s] @ end())").args[0], Subquery)
    assert isinstance(parse("x offset -5m"), Selector)
    assert parse("0x1F") == Number(31)
    assert duration_ms("1h30m") == 5_400_000


@pytest.mark.parametrize("text", ["", "sum(", "x{", "{}", 'x{a=~".*"', '{a=~".*"}', "x[5m", "sum(x[5m])", "1 > 2", "x and 1", "nope(x)", "rate(x)", "x[5m] + 1", "5m30h", "x @ NaN", "topk(x)", 'x{a=~"("}', "-x[5m]"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        parse(text if text != "5m30h" else "x[5m30h]")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("sum by (group) (http_requests)", [("canary", 1100), ("production", 800)]),
        ("avg without (instance, group) (http_requests)", [("api", 200), ("app", 650)]),
        ("count(http_requests)", [(5,)]), ("quantile(0.5, http_requests)", [(300,)]), ("quantile(2, http_requests)", [(math.inf,)]),
        ("topk(1, sum by (job) (http_requests))", [("app", 1300)]), ("max(edge)", [(8,)]), ("min(edge)", [(2,)]), ("sum(edge)", [(math.nan,)]), ("count(edge)", [(3,)]),
        ('count_values("v", floor(edge / 2))', [("1", 1), ("4", 1), ("NaN", 1)]),
        ("rate(foo[15m])", [("api", "0", 1 / 300)]), ("increase(foo[15m])", [("api", "0", 3)]), ("sum_over_time(foo[15m])", [("api", "0", 27)]),
        ("sum_over_time(foo[15m:5m])", [("api", "0", 27)]), ("foo offset 10m", [("foo", "api", "0", 8)]), ("foo @ 600", [("foo", "api", "0", 2)]), ("foo @ start()", [("foo", "api", "0", 10)]),
        ("-2 ^ 2", [(-4,)]), ("1 / 0", [(math.inf,)]), ("0 / 0", [(math.nan,)]), ("-1 / 0", [(-math.inf,)]), ("5 % 0", [(math.nan,)]), ("1 > bool 2", [(0,)]), ("time()", [(3000,)]),
        ("scalar(foo) + scalar(foo)", [(20,)]), ("vector(time())", [(3000,)]), ("scalar(http_requests)", [(math.nan,)]),
        ("sum by (job) (http_requests) > 1000", [("app", 1300)]), ("sum by (job) (http_requests) > bool 1000", [("api", 0), ("app", 1)]),
        ('http_requests{group="canary"} / on (job, instance) foo', [("api", "0", 30)]),
        ("sum by (job) (http_requests * on (job, instance) group_left () foo)", [("api", 4000)]),
        ("count(http_requests and on (instance) foo)", [(3,)]), ("count(http_requests unless on (instance) foo)", [(2,)]), ('count(foo or http_requests{group="canary"})', [(3,)]),
        ("absent(nothing{a=\"b\"})", [("b", 1)]), ("absent(foo)", []), ("histogram_quantile(0.5, h_bucket)", [(1.5,)]), ("round(foo / 3)", [("api", "0", 3)]), ("round(vector(-2.5))", [(-2,)]),
        ("minute()", [(50,)]), ("edge == edge", [("edge", "a", 2), ("edge", "b", 8)]), ("sgn(vector(-3))", [(-1,)]), ("clamp(foo, 0, 5)", [("api", "0", 5)]), ("deriv(foo[15m])", [("api", "0", 1 / 300)]), ("predict_linear(foo[15m], 300)", [("api", "0", 11)]), ("changes(foo[15m])", [("api", "0", 2)]), ("irate(foo[15m])", [("api", "0", 1 / 300)]),
        ('sum by (x) (label_replace(foo, "x", "$1!", "job", "(.).*"))', [("a!", 10)]), ("group(http_requests)", [(1,)]), ("stddev(http_requests)", [(248.1934729,)]),
    ],
)
def test_instant(spark, text, expected):
    q = compile_query(storage(spark, HTTP), text, Grid.instant(3_000_000))
    rows = sorted(tuple(x for x in r[2:] if x is not None) + (r["value"],) for r in q.ordered().collect())
    assert len(rows) == len(expected), rows
    names = [tuple(sorted(map(str, r[:-1]))) for r in rows]
    wanted = sorted(expected, key=lambda e: str(e[:-1]))
    assert sorted(names) == sorted(tuple(sorted(map(str, e[:-1]))) for e in wanted)
    for value, want in zip(sorted((r[-1] for r in rows), key=str), sorted((float(e[-1]) for e in wanted), key=str), strict=True):
        assert (math.isnan(value) and math.isnan(want)) or value == pytest.approx(want, abs=1e-6)


def test_range_lookback_and_stale(spark):
    s = storage(spark, "bar 0 1 10 100 1000", 15)
    q = compile_query(s, "sum_over_time(bar[30s])", Grid(0, 60_000, 30_000))
    assert [(r["step"], r["value"]) for r in q.ordered().collect()] == [(0, 0), (30_000, 11), (60_000, 1100)]
    q = compile_query(s, "bar", Grid(0, 600_000, 60_000))
    assert [r["value"] for r in q.ordered().collect()] == [0, 1000, 1000, 1000, 1000, 1000]
    from pyspark.sql import functions as F

    s.samples = s.samples.withColumn("is_stale", F.col("ts_ms") == 60_000)
    assert compile_query(s, "bar", Grid.instant(60_000)).df.count() == 0


def test_many_to_many_fails(spark):
    s = storage(spark, HTTP)
    for text in ("foo / on (job) http_requests", "http_requests / on (job) foo"):
        with pytest.raises(Exception, match="many-to-many|many-to-one"):
            compile_query(s, text, Grid.instant(3_000_000)).df.collect()


def test_big_averages_stay_finite(spark):
    s = storage(spark, 'big{a="1"} 9.988e307\nbig{a="2"} 9.988e307')
    assert compile_query(s, "avg(big)", Grid.instant(0)).df.first()["value"] == pytest.approx(9.988e307)


def test_selectors_need_no_join(spark):
    plan = compile_query(storage(spark, HTTP), "sum by (job) (rate(http_requests[5m]))", Grid(0, 3_000_000, 60_000)).df._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan


def test_sliding_windows(spark):
    """Windows of many steps against the explosion to steps; gaps, NaN, one sample before the grid."""
    r = random.Random(3)
    rows = [(t, r.choice([1.0, -2.5, float("nan"), 7.25, float("inf")]) if k % 3 else float(t % 13), f"s{k % 4}", "m") for k, t in enumerate(sorted(r.sample(range(-3000, 90_000), 160)))]
    rows = [x for x in rows if not (x[2] == "s1" and 20_000 < x[0] < 70_000)]
    df = spark.createDataFrame(rows, "ts_ms bigint, value double, l_a string, l___name__ string")
    for grid, window in ((Grid(0, 80_000, 500), 10_000), (Grid(700, 60_000, 1000), 16_000), (Grid(0, 9_000, 300), 9_000)):
        for name in sorted(windows._SLIDING):
            many, windows.MANY_STEPS = windows.MANY_STEPS, 1 << 30
            try:
                want = windows.over_range(df, ["__name__", "a"], grid, window, name)
            finally:
                windows.MANY_STEPS = many
            got = windows.over_range(df, ["__name__", "a"], grid, window, name)
            assert "Window" in got._jdf.queryExecution().toString() and "Window" not in want._jdf.queryExecution().toString()
            shown = lambda d: sorted((x["step"], x["l_a"], str(round(x["value"], 6))) for x in d.collect())
            assert shown(got) == shown(want), (name, grid)


def test_exchanges(spark, tmp_path):
    """sum by: one exchange for unique samples besides the final one; rates are partitioned by series once."""
    spark.createDataFrame([(0, 1.0, "m", "x", "y")], "ts_ms bigint, value double, l___name__ string, l_a string, l_b string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda text, **o: compile_query(Storage(df, **o), text, Grid(0, 600_000, 60_000)).df._jdf.queryExecution().executedPlan().toString()
    assert plan("sum by (a) (m)").count("Exchange") == 2
    unique = plan("sum by (a) (m)", unique=True)
    assert unique.count("Exchange") == 2 and "SortAggregate" not in unique
    assert plan("rate(m[5m])").count("Exchange") == 1
