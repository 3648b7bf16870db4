"""Native histograms: sums, differences and scaling of exponential-bucket histograms, and what is read from them.

A histogram is a struct (see HISTOGRAM) with sparse buckets: bucket i of schema s holds values in (b^(i-1), b^i] with
b = 2^(2^-s), those of `neg` the same with the sign turned; zero_count holds values within zero_threshold of 0. All is
built-in expressions. Groups of histograms are added bucket by bucket with map-side combination, so no task holds more
of a group than its distinct buckets.

Nulls: a null histogram does not count. Histograms of different schemas meet at the coarsest; of different zero
thresholds at the widest, which grows to the end of a filled bucket that it cuts. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..model import Grid, column, label
from . import windows

HISTOGRAM = "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,pos:array<struct<i:int,c:double>>,neg:array<struct<i:int,c:double>>>"

#: Parts of a histogram as rows: 1 and -1 are buckets.
_ZERO, _COUNT, _SUM, _NUMBER = 0, 2, 3, 4


def upper(i: Column, schema: Column) -> Column:
    """The larger bound of bucket i, in absolute value; bucket i - 1 has the smaller."""
    return F.pow(F.lit(2.0), i * F.pow(F.lit(2.0), -schema.cast("double")))


def coarser(i: Column, by: Column) -> Column:
    """The bucket that holds bucket i in a schema smaller by `by`."""
    return (F.floor((i - 1) / F.pow(F.lit(2.0), by.cast("double"))) + 1).cast("int")


def bucket_of(value: Column, schema: int) -> Column:
    """The bucket of a number other than 0."""
    return F.ceil(F.round(F.log2(F.abs(value)) * 2.0**schema, 9)).cast("int")


def added(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """The sum of column `value` (histograms), times `weight`, for each group: the keys, `value`, and `n`, the sum of weights."""
    h, w = F.col("value"), F.lit(1.0) if weight is None else weight.cast("double")
    part = lambda side, i, c: F.struct(F.lit(side).alias("side"), i.alias("i"), c.alias("c"))
    single = [part(_ZERO, F.lit(0), h["zero_count"]), part(_COUNT, F.lit(0), h["count"]), part(_SUM, F.lit(0), h["sum"]), part(_NUMBER, F.lit(0), F.lit(1.0))]
    parts = F.concat(F.array(*single), F.transform(h["pos"], lambda b: part(1, b["i"], b["c"])), F.transform(h["neg"], lambda b: part(-1, b["i"], b["c"])))
    own = [F.col(f"`{k}`") for k in keys]
    rows = rows.where("value is not null").select(*own, h["schema"].alias("schema"), h["zero_threshold"].alias("zero"), w.alias("weight"), F.explode(parts).alias("part"))
    rows = rows.groupBy(*own, "schema", "zero", "part.side", "part.i").agg(F.sum(F.col("part.c") * F.col("weight")).alias("c"))
    group = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"least": F.min("schema").over(group), "narrow": F.min("zero").over(group), "wide": F.max("zero").over(group)})
    side, bucket = F.col("side"), F.col("side").isin(1, -1)
    rows = rows.withColumn("i", F.when(bucket, coarser(F.col("i"), F.col("schema") - F.col("least"))).otherwise(0))
    high, low = upper(F.col("i"), F.col("least")), upper(F.col("i") - 1, F.col("least"))
    differ = F.col("narrow") < F.col("wide")
    cut = F.when(differ & bucket & (F.col("c") != 0) & (low < F.col("wide")) & (high > F.col("wide")), high)
    rows = rows.withColumn("wide", F.coalesce(F.greatest("wide", F.max(cut).over(group)), F.col("wide")))
    inside = differ & bucket & (high <= F.col("wide"))
    rows = rows.withColumns({"side": F.when(inside, _ZERO).otherwise(side), "i": F.when(inside, 0).otherwise(F.col("i"))})
    rows = rows.groupBy(*own, "least", "wide", "side", "i").agg(F.sum("c").alias("c"))
    one = lambda k: F.max(F.when(side == k, F.col("c")))
    # as many buckets as schema and range of the numbers allow, not rows
    buckets = lambda k: F.array_sort(F.collect_list(F.when((side == k) & (F.col("c") != 0), F.struct("i", "c"))))
    out = F.struct(F.col("least").alias("schema"), F.col("wide").alias("zero_threshold"), F.col("zero_count"), F.col("count"), F.col("sum"), F.col("pos"), F.col("neg"))
    rows = rows.groupBy(*own, "least", "wide").agg(one(_ZERO).alias("zero_count"), one(_COUNT).alias("count"), one(_SUM).alias("sum"), one(_NUMBER).alias("n"), buckets(1).alias("pos"), buckets(-1).alias("neg"))
    return rows.select(*own, out.cast(HISTOGRAM).alias("value"), "n")


def scaled(h: Column, factor: Column) -> Column:
    """Every count of a histogram, times a number."""
    each = lambda name: F.transform(h[name], lambda b: F.struct(b["i"].alias("i"), (b["c"] * factor).alias("c")))
    return F.struct(h["schema"].alias("schema"), h["zero_threshold"].alias("zero_threshold"), *((h[x] * factor).alias(x) for x in ("zero_count", "count", "sum")), each("pos").alias("pos"), each("neg").alias("neg"))


def _buckets(h: Column) -> Column:
    """Filled buckets by rising value: array of (low, high, c). Without buckets of one sign, zero's stops at 0 there."""
    span = lambda low, high, c: F.struct(low.alias("low"), high.alias("high"), c.alias("c"))
    down = F.transform(F.reverse(h["neg"]), lambda b: span(-upper(b["i"], h["schema"]), -upper(b["i"] - 1, h["schema"]), b["c"]))
    up = F.transform(h["pos"], lambda b: span(upper(b["i"] - 1, h["schema"]), upper(b["i"], h["schema"]), b["c"]))
    has = lambda name: F.size(h[name]) > 0
    zero = span(F.when(has("pos") & ~has("neg"), 0.0).otherwise(-h["zero_threshold"]), F.when(has("neg") & ~has("pos"), 0.0).otherwise(h["zero_threshold"]), h["zero_count"])
    return F.filter(F.concat(down, F.array(zero), up), lambda b: b["c"] > 0)


def _within(b: Column, share: Column) -> Column:
    """The number at a share of a bucket's way: on a line around 0, else in the exponent."""
    low, high = b["low"], b["high"]
    middle = (low <= 0) & (high >= 0)
    # bounds of other buckets stand in for the branch that is not taken
    a, z = F.log2(F.abs(F.when(~middle, low))), F.log2(F.abs(F.when(~middle, high)))
    return F.when(middle, low + (high - low) * share).when(low > 0, F.pow(F.lit(2.0), a + (z - a) * share)).otherwise(-F.pow(F.lit(2.0), a + (z - a) * share))


def quantile(h: Column, q: Column) -> Column:
    """The q-quantile; counted from the nearer end, from below where the sum is NaN."""
    below = (q < 0.5) | F.isnan(h["sum"])
    rank = F.when(below, q).otherwise(F.lit(1.0) - q) * h["count"]
    found = F.when(below, _buckets(h)).otherwise(F.reverse(_buckets(h)))
    start = F.struct(rank.alias("left"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("end"))

    def step(at: Column, b: Column) -> Column:
        share = F.greatest(at["left"], F.lit(0.0)) / b["c"]
        hit = F.when(b["c"] >= at["left"], _within(b, F.when(below, share).otherwise(F.lit(1.0) - share)))
        return F.struct((at["left"] - b["c"]).alias("left"), F.coalesce(at["value"], hit).alias("value"), F.when(below, b["high"]).otherwise(b["low"]).alias("end"))

    value = F.aggregate(found, start, step, lambda at: F.coalesce(at["value"], F.when(F.isnan(h["sum"]), ieee.NAN).otherwise(at["end"])))
    return F.when(F.isnan(q) | (h["count"] == 0), ieee.NAN).when(q < 0, -ieee.INF).when(q > 1, ieee.INF).otherwise(F.coalesce(value, F.lit(ieee.NAN)))


def fraction(h: Column, low: Column, high: Column) -> Column:
    """The estimated share of observations between two numbers."""

    def share(b: Column, x: Column) -> Column:
        middle = (b["low"] <= 0) & (b["high"] >= 0)
        exponent = lambda v: F.log2(F.abs(v))
        curve = (exponent(x) - exponent(b["low"])) / (exponent(b["high"]) - exponent(b["low"]))
        return F.when(x <= b["low"], 0.0).when(x >= b["high"], 1.0).when(middle, (x - b["low"]) / (b["high"] - b["low"])).otherwise(curve)

    total = F.aggregate(_buckets(h), F.lit(0.0), lambda s, b: s + b["c"] * (share(b, high) - share(b, low)))
    return F.when((h["count"] == 0) | F.isnan(low) | F.isnan(high), ieee.NAN).when(low >= high, 0.0).otherwise(total / h["count"])


def variance(h: Column) -> Column:
    """Of observations that stand at the geometric middle of their buckets, at 0 in zero's."""
    mean = ieee.divide(h["sum"], h["count"])
    middle = lambda b: F.when((b["low"] <= 0) & (b["high"] >= 0), 0.0).otherwise(F.signum(b["high"]) * F.sqrt(F.abs(b["low"] * b["high"])))
    return ieee.divide(F.aggregate(_buckets(h), F.lit(0.0), lambda s, b: s + b["c"] * F.pow(middle(b) - mean, F.lit(2.0))), h["count"])


#: Numbers read from a histogram, and the parameters that come before it.
NUMBERS = {
    "histogram_count": lambda h: h["count"], "histogram_sum": lambda h: h["sum"], "histogram_avg": lambda h: ieee.divide(h["sum"], h["count"]),
    "histogram_stdvar": variance, "histogram_stddev": lambda h: F.sqrt(variance(h)), "histogram_fraction": fraction, "histogram_quantile": quantile,
}


def fell(h: Column, before: Column) -> Column:
    """Was the counter reset between two histograms: did any part of it fall, or its resolution rise?"""
    by = F.greatest(before["schema"] - h["schema"], F.lit(0))
    wider = h["zero_threshold"] > before["zero_threshold"]
    total = lambda buckets: F.aggregate(buckets, F.lit(0.0), lambda s, b: s + b["c"])
    at = lambda buckets, i: total(F.filter(buckets, lambda b: b["i"] == i))
    swallowed = lambda b: wider & (upper(b["i"], h["schema"]) <= h["zero_threshold"])

    def side(name: str) -> tuple[Column, Column]:
        """What zero's bucket took over, and whether a bucket fell."""
        old = F.transform(before[name], lambda b: F.struct(coarser(b["i"], by).alias("i"), b["c"].alias("c")))
        rest = F.filter(old, lambda b: ~swallowed(b))
        return total(F.filter(old, swallowed)), F.exists(rest, lambda b: at(rest, b["i"]) > at(h[name], b["i"]))

    (up, up_fell), (down, down_fell) = side("pos"), side("neg")
    less = (h["count"] < before["count"]) | (h["schema"] > before["schema"]) | (h["zero_threshold"] < before["zero_threshold"])
    return less | up_fell | down_fell | (h["zero_count"] < before["zero_count"] + up + down)


#: Functions of ranges of histograms that give histograms.
OVER_RANGE = {"rate", "increase", "delta", "sum_over_time", "avg_over_time", "last_over_time"}


def over_range(samples: DataFrame, labels: list[str], grid: Grid, window: int, name: str) -> DataFrame:
    """step, value: a range function of each series' histograms over (step - window, step].

    Differences are sums with weights: 1 for the last histogram of a window, -1 for the first, and 1 for each that stands
    before a reset; all others drop out before buckets are looked at.
    """
    keys, names = [label(x) for x in labels], [column(x) for x in labels]
    rows = samples.where("not is_stale") if "is_stale" in samples.columns else samples
    if name == "last_over_time":
        return windows.over_range(rows, labels, grid, window, name)
    rows = rows.where((F.col("ts_ms") > grid.start - window) & (F.col("ts_ms") <= grid.last))
    if name in ("sum_over_time", "avg_over_time"):
        found = added(windows.stepped(rows, grid, window), ["step", *names])
        value = F.col("value") if name == "sum_over_time" else scaled(F.col("value"), F.lit(1.0) / F.col("n"))
        return found.select("step", value.alias("value"), *keys)
    series = Window.partitionBy(*keys).orderBy("ts_ms")
    if name == "delta":
        rows = rows.withColumn("reset", F.lit(False))
    else:  # the one before as a column of its own: fell() looks at it many times
        rows = rows.withColumn("before", F.lag("value").over(series))
        rows = rows.withColumn("reset", F.coalesce(fell(F.col("value"), F.col("before")), F.lit(False))).drop("before")
    rows = windows.stepped(rows, grid, window)
    here = Window.partitionBy("step", *keys)
    follows = F.lead("reset").over(here.orderBy("ts_ms"))
    rows = rows.withColumns({"n": F.count("*").over(here), "first": F.min("ts_ms").over(here), "last": F.max("ts_ms").over(here), "follows": F.coalesce(follows, F.lit(False))})
    ts = F.col("ts_ms")
    start = F.max(F.when(ts == F.col("first"), F.col("value.count"))).over(here)
    weight = (ts == F.col("last")).cast("int") - (ts == F.col("first")).cast("int") + F.col("follows").cast("int")
    rows = rows.where("n > 1").withColumns({"start": start, "times": weight}).where("times != 0 or ts_ms = last")
    rows = rows.withColumnRenamed("n", "samples")
    found = added(rows, ["step", *names, "samples", "first", "last", "start"], F.col("times"))
    sampled = (F.col("last") - F.col("first")) / 1000.0
    between = sampled / (F.col("samples") - 1)
    edge = lambda c: F.when(c >= between * 1.1, between / 2).otherwise(c)
    before = edge((F.col("first") - F.col("step") + window) / 1000.0)
    if name != "delta":  # a counter does not fall below zero
        zero = sampled * ieee.divide(F.col("start"), F.col("value.count"))
        before = F.when((F.col("value.count") > 0) & (F.col("start") >= 0) & (zero < before), zero).otherwise(before)
    factor = (sampled + before + edge((F.col("step") - F.col("last")) / 1000.0)) / sampled
    return found.select("step", scaled(F.col("value"), factor / (window / 1000.0) if name == "rate" else factor).alias("value"), *keys)
