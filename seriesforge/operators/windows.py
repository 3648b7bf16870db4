"""Evaluating samples on a time grid: instant lookback and range functions, without joins.

A sample at ts serves the steps s with s - window < ts <= s (left-open, right-closed); exploding it to those steps
gives one row per sample and step, which one grouping then reduces with map-side combination. Windows of many steps are
not exploded: samples are summed up by step first, and every window is the end of one block of steps and the beginning
of the next, whose running aggregates cost one row per series and step (see sliding()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..model import NAME, Grid, label


def stepped(samples: DataFrame, grid: Grid, window: int) -> DataFrame:
    """Samples (ts_ms, ...) with each `step` that they serve."""
    ts = F.col("ts_ms")
    first = F.greatest(F.lit(0), F.ceil((ts - grid.start) / grid.step))
    last = F.least(F.lit((grid.last - grid.start) // grid.step), F.floor((ts + (window - 1) - grid.start) / grid.step))
    rows = samples.where((ts > grid.start - window) & (ts <= grid.last))
    if grid.start == grid.last:
        return rows.withColumn("step", F.lit(grid.start))
    k = F.when(last >= first, F.sequence(first, last))
    return rows.withColumn("step", F.explode(k)).withColumn("step", F.lit(grid.start) + F.col("step") * grid.step)


def instant(samples: DataFrame, labels: list[str], grid: Grid, lookback: int) -> DataFrame:
    """step, value, sample_ts: each series' latest sample within the lookback; a stale marker ends a series.

    `samples` may hold several of one series and time; the one with the least `tie` counts, so one grouping merges
    samples and looks them up.
    """
    keys = [label(x) for x in labels]
    rows = stepped(samples, grid, lookback).groupBy("step", *keys)
    if "tie" in samples.columns:
        best = F.min(F.struct((-F.col("ts_ms")).alias("back"), "tie", "value", "is_stale")).alias("best")
        found = rows.agg(best).where("not best.is_stale")
        return found.select("step", F.col("best.value").alias("value"), (-F.col("best.back")).alias("sample_ts"), *keys)
    # of unique samples plain maxima do, which are aggregated by hash
    found = rows.agg(F.max_by("value", "ts_ms").alias("value"), F.max_by("is_stale", "ts_ms").alias("is_stale"), F.max("ts_ms").alias("sample_ts"))
    return found.where("not is_stale").select("step", "value", "sample_ts", *keys)


#: Windows of this many steps or more slide.
MANY_STEPS = 16
_SLIDING = {"sum_over_time", "count_over_time", "min_over_time", "max_over_time", "present_over_time", "last_over_time"}


def sliding(samples: DataFrame, labels: list[str], grid: Grid, window: int, name: str) -> DataFrame:
    """step, value: a function over windows of a whole number of steps, with one row per series and step.

    b is the first step that a sample serves; windows hold n = window / step of them. With blocks of n steps, the window
    that ends at k is what its block has up to k, and what the block before has from k - n + 1 on.
    """
    n, last = window // grid.step, (grid.last - grid.start) // grid.step
    keys = [label(x) for x in labels]
    v = F.col("value")
    number = F.when(~F.isnan(v), v)
    partial = {"sum_over_time": [F.sum(v)], "min_over_time": [F.min(number)], "max_over_time": [F.max(number)], "last_over_time": [F.max_by(v, "ts_ms")]}.get(name, [])
    rows = samples.withColumn("b", F.ceil((F.col("ts_ms") - grid.start) / grid.step))
    own = [label(x) for x in labels if x != NAME] or keys
    rows = rows.repartition(*own) if own else rows  # one exchange; all that follows is within series
    rows = rows.groupBy(*keys, "b").agg(F.count("*").alias("c"), *(x.alias("p") for x in partial))
    p = F.col("p") if partial else F.lit(None).cast("double")
    series = Window.partitionBy(*keys).orderBy("b")
    # up to the next row but, in long gaps, where windows are empty, only n steps behind this row and before the next
    # one; the first row has them before it, too
    rows = rows.withColumns({"follows": F.lead("b").over(series), "from": F.when(F.lag("b").over(series).isNull(), F.col("b") - (n - 1)).otherwise(F.col("b"))})
    follows = F.col("follows")
    end, again = F.coalesce(follows - 1, F.lit(last)), F.greatest(F.col("b") + n, follows - (n - 1))
    ks = F.concat(F.sequence("from", F.greatest("b", F.least(end, F.col("b") + (n - 1)))), F.when(follows.isNotNull() & (again <= end), F.sequence(again, end)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("*", F.explode(ks).alias("k"))
    here = F.col("k") == F.col("b")
    rows = rows.select(*keys, "k", F.floor(F.col("k") / n).alias("block"), F.when(here, F.col("c")).otherwise(0).alias("c"), F.when(here, p).alias("p"))
    before = Window.partitionBy(*keys, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*keys, "block").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    merge = {"min_over_time": F.min, "max_over_time": F.max}.get(name, F.sum)
    head = F.last("p", ignorenulls=True) if name == "last_over_time" else merge("p")
    tail = F.first("p", ignorenulls=True) if name == "last_over_time" else merge("p")  # falling order: the first is the latest
    rows = rows.withColumns({"hc": F.sum("c").over(before), "hp": head.over(before), "tc": F.sum("c").over(behind), "tp": tail.over(behind)})
    # the row of step k - n + 1; there is none only if nothing stands in its block behind it
    far = Window.partitionBy(*keys).orderBy("k").rangeBetween(-(n - 1), -(n - 1))
    near = F.pmod(F.col("k") + 1, F.lit(n)) != 0  # else the window is the block itself
    rows = rows.withColumns({"tc": F.when(near, F.max("tc").over(far)), "tp": F.when(near, F.max("tp").over(far))})
    c = F.col("hc") + F.coalesce("tc", F.lit(0))
    both = {
        "sum_over_time": F.when(F.col("hp").isNull(), F.col("tp")).otherwise(F.col("hp") + F.coalesce("tp", F.lit(0.0))), "count_over_time": c.cast("double"), "present_over_time": F.lit(1.0),
        "min_over_time": F.coalesce(F.least("hp", "tp"), F.lit(ieee.NAN)), "max_over_time": F.coalesce(F.greatest("hp", "tp"), F.lit(ieee.NAN)), "last_over_time": F.coalesce("hp", "tp"),
    }[name]
    return rows.where((c > 0) & F.col("k").between(0, last)).select((F.lit(grid.start) + F.col("k") * grid.step).alias("step"), both.alias("value"), *keys)


#: Functions that need each sample's predecessor within its series.
WITH_PREVIOUS = {"rate", "increase", "delta", "irate", "idelta", "changes", "resets"}


def over_range(samples: DataFrame, labels: list[str], grid: Grid, window: int, name: str, parameter: Column | None = None) -> DataFrame:
    """step, value: a range function of each series over (step - window, step].

    `samples` may hold several of one series and time, all of which count, in the order of their `tie`; the first and the
    last of a window are the ones with the least.
    """
    keys = [label(x) for x in labels]
    if "is_stale" in samples.columns:
        samples = samples.where("not is_stale")
    rows = samples.where((F.col("ts_ms") > grid.start - window) & (F.col("ts_ms") <= grid.last))
    if name in _SLIDING and window % grid.step == 0 and window // grid.step >= MANY_STEPS and grid.last > grid.start:
        return sliding(rows, labels, grid, window, name)
    if name in WITH_PREVIOUS:
        order = Window.partitionBy(*keys).orderBy("ts_ms", *(["tie"] if "tie" in samples.columns else []))
        pv, v = F.lag("value").over(order), F.col("value")
        rows = rows.withColumn("pv", pv).withColumn("pt", F.lag("ts_ms").over(order))
        again = (F.coalesce(F.col("pt"), F.col("ts_ms") - 1) == F.col("ts_ms")).cast("int")
        rows = rows.withColumns({"early": F.col("ts_ms") * 2 + again, "late": F.col("ts_ms") * 2 - again})
        changed = (v != F.col("pv")) & ~(F.isnan("value") & F.isnan("pv"))
        rows = rows.withColumn("reset", F.coalesce(F.when(ieee.compare("<", v, F.col("pv")), F.col("pv")), F.lit(0.0)))
        rows = rows.withColumn("fell", F.coalesce((F.col("reset") != 0) | ieee.compare("<", v, F.col("pv")), F.lit(False)).cast("double")).withColumn("changed", F.coalesce(changed, F.lit(False)).cast("double"))
    if parameter is not None:
        rows = rows.withColumn("seconds", F.col("ts_ms") / 1000.0)
    rows = stepped(rows, grid, window)
    group = rows.groupBy("step", *keys)
    v = F.col("value")
    simple = {
        "sum_over_time": F.sum(v), "avg_over_time": ieee.mean(v), "min_over_time": ieee.least(v), "max_over_time": ieee.greatest(v), "count_over_time": F.count("*").cast("double"),
        "stddev_over_time": F.stddev_pop(v), "stdvar_over_time": F.var_pop(v), "last_over_time": F.max_by(v, "ts_ms"), "present_over_time": F.max(F.lit(1.0)),
    }
    if name in simple:
        return group.agg(simple[name].alias("value")).select("step", "value", *keys)
    if name == "quantile_over_time":
        return group.agg(ieee.quantile(v, parameter).alias("value")).select("step", "value", *keys)
    if name in ("deriv", "predict_linear"):
        x = (F.col("ts_ms") - F.col("step")) / 1000.0
        slope, level = F.regr_slope(v, x), F.regr_intercept(v, x)
        value = slope if name == "deriv" else level + slope * F.max(parameter)
        return group.agg(F.coalesce(value, F.lit(ieee.NAN)).alias("value"), F.count("*").alias("n")).where("n > 1").select("step", "value", *keys)
    if name in ("irate", "idelta"):
        last = F.max_by(F.struct("value", "ts_ms", "pv", "pt", "reset"), "late").alias("x")
        found = group.agg(last).where(F.col("x.pt") > F.col("step") - window)
        change = F.col("x.value") - F.col("x.pv")
        value = F.when(F.col("x.value") < F.col("x.pv"), F.col("x.value")).otherwise(change) / ((F.col("x.ts_ms") - F.col("x.pt")) / 1000.0) if name == "irate" else change
        return found.select("step", value.alias("value"), *keys)
    if name in ("changes", "resets"):
        c = "changed" if name == "changes" else "fell"
        return group.agg((F.sum(c) - F.min_by(c, "early")).alias("value")).select("step", "value", *keys)
    # rate, increase, delta: the change between first and last sample, extrapolated towards the window's edges
    first, last = F.min_by(F.struct("value", "ts_ms", "reset"), "early").alias("a"), F.max_by(F.struct("value", "ts_ms"), "late").alias("b")
    found = group.agg(first, last, F.count("*").alias("n"), F.sum("reset").alias("resets")).where("n > 1")
    counter = name != "delta"
    change = F.col("b.value") - F.col("a.value") + (F.col("resets") - F.col("a.reset") if counter else 0)
    found = found.select("step", *keys, change.alias("change"), F.col("a.value").alias("v0"), ((F.col("b.ts_ms") - F.col("a.ts_ms")) / 1000.0).alias("sampled"),
                         ((F.col("a.ts_ms") - F.col("step") + window) / 1000.0).alias("before"), ((F.col("step") - F.col("b.ts_ms")) / 1000.0).alias("behind"), "n")
    between = F.col("sampled") / (F.col("n") - 1)
    edge = lambda c: F.when(c >= between * 1.1, between / 2).otherwise(c)
    before = edge(F.col("before"))
    if counter:  # a counter does not fall below zero
        zero = F.col("sampled") * ieee.divide(F.col("v0"), F.col("change"))
        before = F.when((F.col("change") > 0) & (F.col("v0") >= 0) & (zero < before), zero).otherwise(before)
    value = F.col("change") * ieee.divide(F.col("sampled") + before + edge(F.col("behind")), F.col("sampled"))  # all samples may be of one time
    return found.select("step", (value / (window / 1000.0) if name == "rate" else value).alias("value"), *keys)
