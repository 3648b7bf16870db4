"""Mixing sources to target weights by entropy balancing.

Rates w of documents minimise the relative entropy to one copy each, within 0 and `cap` copies, under one token
constraint per source: the sum of w * size equals the source's target. The convex dual separates by source, with
exponentially tilted rates w = cap / (1 + (cap - 1) * exp(-t * size)). Newton iterations over the (source, size) cells
of a source find its t inside a bracket that grows until it holds t; a source that misses its target by more than the
tolerance raises an error. Rates are rounded into whole copies,
cell by cell from the largest size on, each cell taking over the error of those before, so that a source misses its
target by about half of its smallest document (more only if one text outweighs all others of its source); within a cell, hashes of ids decide which documents get one copy more.

Targets: sources in code-point order, null last, have weights that repeat; they share all sizes, but none more than
`cap` times its own size, the excess is shared again by weight.

Nulls: a null text has size 0; null is a source of its own, the last; a null doc_id is kept. Rows that repeat doc_id,
source and size share one decision. Documents of size 0 get one copy. An empty table gives no rows. A group of one row
per source and one row per distinct size of a source are what meets in one task. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words end at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 1024


def size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(cells: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """One row per source: s (its number), source, source_size, target."""
    mass = F.col("n") * F.col("k") * F.col("size")
    sources = cells.groupBy("source").agg(F.sum(mass).alias("source_size"))
    s = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("s", s).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("s") - 1) % len(weights) + 1).cast("int")))
    # sources reach their caps in order of cap / weight: level is the share per weight if all before are at their caps
    most = cap * F.col("source_size").cast("double")
    order = Window.orderBy(most / F.col("weight"), "s")
    before = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (whole - before) / behind)
    ratio = most / F.col("weight")
    first = F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), "s", "level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(most, F.coalesce(first["level"] * F.col("weight"), most))
    return sources.select("s", "source", "source_size", target.alias("target"))


#: Exponents beyond it, and tilts per word beyond it, change no rate: no text that counts has less than one word.
FAR = 700.0


def rate(tilt: float, size: np.ndarray, cap: int) -> np.ndarray:
    """Copies of documents in the mix, before rounding."""
    return cap / (1.0 + (cap - 1) * np.exp(-np.clip(tilt * size, -FAR, FAR)))


def rounded(tilt: float) -> float:
    """To 12 digits: what the last ones are depends on the machine, and rates decide about copies."""
    return float(f"{tilt:.11e}")


def solved(size: np.ndarray, mass: np.ndarray, target: float, cap: int, tolerance: float = 1e-9) -> float:
    """The tilt at which rates times `mass` add up to `target`, by Newton steps inside a bracket.

    The bracket starts at one over the largest size and doubles or halves until it holds the tilt; a Newton step that
    leaves it, or follows one that did not halve it, is replaced by its middle. Targets at the cap are reached in the
    limit, where the tilt is FAR.
    """
    size, mass = size[mass > 0], mass[mass > 0]
    whole = float(mass.sum())
    if target >= cap * whole * (1 - tolerance):
        return FAR

    def miss(t: float) -> float:
        return float((mass * rate(t, size, cap)).sum()) - target

    near = lambda gap: abs(gap) <= tolerance * target
    if near(whole - target):
        return 0.0
    side = 1.0 if target > whole else -1.0
    outer = 1.0 / float(size.max())
    while outer < FAR and side * miss(side * outer) < 0:
        outer = min(2 * outer, FAR)
    while side * miss(side * outer / 2) > 0:
        outer /= 2
    low, high = sorted((side * outer / 2, side * outer))
    t, width = (low + high) / 2, high - low
    for _ in range(200):
        w = rate(t, size, cap)
        gap = float((mass * w).sum()) - target
        if near(gap):
            return rounded(t)
        low, high = (t, high) if gap < 0 else (low, t)
        slope = float((mass * size * w * (1 - w / cap)).sum())
        step = t - gap / slope if slope > 0 else low
        halved, width = high - low <= width / 2, high - low
        t = step if halved and low < step < high else (low + high) / 2
    raise ArithmeticError(f"no tilt meets a source's target of {target} words of {whole}")


def copies(cells: DataFrame, cap: int) -> DataFrame:
    """Whole copies of each cell (s, size, k, n, target): every document gets `base`, `extra` of the cell one more."""

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "k"], ascending=False, ignore_index=True)
        size = group["size"].to_numpy(float)
        tilt = solved(size, group["n"].to_numpy(float) * group["k"].to_numpy(float) * size, float(group["target"].iloc[0]), cap)
        group["rate"] = rate(tilt, size, cap)
        error, base, extra = 0.0, [], []
        for n, k, words, w in zip(group["n"].tolist(), group["k"].tolist(), group["size"].tolist(), group["rate"].tolist(), strict=True):
            unit = k * words
            whole = n if unit == 0 else min(max(int(n * w + error / unit + 0.5), 0), cap * n)
            error += unit * (n * w - whole)
            base.append(whole // n)
            extra.append(whole % n)
        group["base"], group["extra"] = base, extra
        return group[["s", "size", "k", "n", "rate", "base", "extra"]]

    return cells.groupBy("s").applyInPandas(spread, "s int, size bigint, k bigint, n bigint, rate double, base bigint, extra bigint")


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per distinct (doc_id, source, size): k rows have it, each gets `copies`; source_size, target and rate."""
    units = docs.select("doc_id", "source", size().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("k"))
    units = common.staged(units, "mix-units")
    counted = common.staged(units.groupBy("source", "size", "k").agg(F.count("*").alias("n")), "mix-cells")
    sources = common.staged(targets(counted, weights, cap), "mix-sources")
    cells = common.staged(counted.join(sources.select("s", "source", "target"), counted["source"].eqNullSafe(sources["source"])).select("s", "size", "k", "n", "target"), "mix-cells")
    cell = ["s", "size", "k"]
    shares = common.staged(copies(cells, cap), "mix-copies")
    numbered = sources.select("s", F.col("source").alias("name"), "source_size", "target")
    units = units.join(numbered, units["source"].eqNullSafe(numbered["name"])).drop("name").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = units.groupBy(*cell, "salt").agg(F.count("*").alias("m"))
    salted = salted.withColumn("upto", F.sum("m").over(Window.partitionBy(*cell).orderBy("salt")))
    upto = lambda x: F.floor(F.col("extra") * (x / F.col("n")))
    salted = salted.join(shares, cell).select(*cell, "salt", "base", "rate", (upto(F.col("upto")) - upto(F.col("upto") - F.col("m"))).alias("more"))
    chosen = units.join(salted, [*cell, "salt"])
    number = F.row_number().over(Window.partitionBy(*cell, "salt").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id"))
    return chosen.withColumn("copies", F.col("base") + (number <= F.col("more")).cast("bigint")).select("doc_id", "source", "size", "k", "source_size", "target", "rate", "copies")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate."""
    p = plan(docs, weights, cap)
    return p.select(F.explode(F.array_repeat(F.struct("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"), F.col("k").cast("int"))).alias("d")).select("d.*")


def taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents as the mix has them: a row of `docs` occurs as often as it has copies, all columns as they are."""
    p = plan(docs, weights, cap).select(F.col("doc_id").alias("p_doc_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("copies").alias("p_copies"))
    p = p.where("p_copies > 0").toDF(*(_fresh(x, docs.columns) for x in p.columns))
    i, s, z, c = p.columns
    rows = docs.join(p, docs["doc_id"].eqNullSafe(p[i]) & docs["source"].eqNullSafe(p[s]) & (size() == p[z]))
    return rows.withColumn(c, F.explode(F.array_repeat(F.lit(1), F.col(c).cast("int")))).select(*(docs[x] for x in docs.columns))


def _fresh(name: str, used: list[str]) -> str:
    while name in used:
        name += "_"
    return name
