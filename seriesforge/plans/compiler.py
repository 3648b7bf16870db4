"""From syntax trees to one lazy DataFrame per expression: step, value and a column l_<label> per label.

Label columns are known at compile time, so grouping and matching keys are plain columns. Absent labels are null and
equal the empty string; equality of keys is null-safe.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.re2 import Pattern
from ..model import HIST, NAME, Grid, QueryError, column, label
from ..operators import histograms, windows
from ..operators.select import Storage
from .functions import mapped
from .parser import COMPARISONS, Aggregate, At, Binary, Call, Expr, Matching, Number, Selector, String, Subquery, Unary, kind, parse


@dataclass
class Vector:
    df: DataFrame
    labels: list[str]

    def keys(self) -> list[Column]:
        return [label(x) for x in self.labels]

    def with_value(self, value: Column, named: bool = False) -> Vector:
        names = self.labels if named else [x for x in self.labels if x != NAME]
        return Vector(self.df.select("step", value.alias("value"), *(label(x) for x in names)), names)

    def having(self, labels: list[str]) -> Vector:
        """With null columns for missing labels, in the given order."""
        return Vector(self.df.select("step", "value", *(label(x) if x in self.labels else F.lit(None).cast("string").alias(column(x)) for x in labels)), labels)


@dataclass
class Compiler:
    spark: SparkSession
    storage: Storage
    whole: Grid | None = None
    subquery_step: int = 60_000

    # -- scalars are columns over `step` where they can be, else DataFrames joined by step

    def scalar(self, e: Expr, grid: Grid) -> Column | DataFrame:
        """A column expression over `step`, or a DataFrame (step, s)."""
        match e:
            case Number():
                return F.lit(e.value)
            case Unary():
                x = self.scalar(e.expr, grid)
                sign = -1.0 if e.op == "-" else 1.0
                return x * sign if isinstance(x, Column) else x.select("step", (F.col("s") * sign).alias("s"))
            case Call(name="time"):
                return F.col("step") / 1000.0
            case Call(name="pi"):
                return F.lit(3.141592653589793)
            case Call(name="scalar"):
                v = self.vector(e.args[0], grid)
                one = v.df.groupBy("step").agg(F.count("*").alias("n"), F.max("value").alias("value"))
                steps = self.steps(grid).join(one, "step", "left")
                return steps.select("step", F.when(F.col("n") == 1, F.col("value")).otherwise(F.lit(ieee.NAN)).alias("s"))
            case Binary():
                a, b = self.scalar(e.left, grid), self.scalar(e.right, grid)
                f = (lambda x, y: ieee.compare(e.op, x, y).cast("double")) if e.op in COMPARISONS else ieee.ARITHMETIC[e.op]
                if isinstance(a, Column) and isinstance(b, Column):
                    return f(a, b)
                df, x = self.beside(self.steps(grid), a, "x")
                df, y = self.beside(df, b, "y")
                return df.select("step", f(x, y).alias("s"))
        raise QueryError("parse error: expected a scalar")

    def steps(self, grid: Grid) -> DataFrame:
        return self.spark.range(1).select(F.explode(grid.times()).alias("step"))

    def beside(self, df: DataFrame, s: Column | DataFrame, name: str) -> tuple[DataFrame, Column]:
        """`df` with a scalar at hand: one row per step, so its table is small beside any vector."""
        if isinstance(s, Column):
            return df, s
        return df.join(s.withColumnRenamed("s", name), "step"), F.col(name)

    # -- vectors

    def vector(self, e: Expr, grid: Grid) -> Vector:
        match e:
            case Selector():
                v = self.instant(e, grid)
                return Vector(v.df.drop("sample_ts"), v.labels)
            case Unary():
                v = self.vector(e.expr, grid)
                return v if e.op == "+" else v.with_value(-F.col("value"))
            case Aggregate():
                return self.aggregate(e, grid)
            case Binary():
                return self.binary(e, grid)
            case Call():
                return self.call(e, grid)
        raise QueryError(f"parse error: expected an instant vector, got {kind(e)}")

    def pinned(self, at: At | None, offset: int, grid: Grid) -> tuple[Grid, bool]:
        """The grid on which a selector is looked up before its offset, and whether that is one pinned time."""
        if at is None:
            return Grid(grid.start - offset, grid.last - offset, grid.step), False
        whole = self.whole or grid
        ms = {"start": whole.start, "end": whole.last}[at.edge] if at.edge else at.ms
        return Grid.instant(ms - offset), True

    def back(self, df: DataFrame, at: At | None, offset: int, grid: Grid) -> DataFrame:
        """Results of pinned() on the grid of the query."""
        if at is None:
            return df.withColumn("step", F.col("step") + offset) if offset else df
        return df.drop("step").withColumn("step", F.explode(grid.times()))

    def instant(self, e: Selector, grid: Grid, of: str = "value") -> Vector:
        own, _ = self.pinned(e.at, e.offset, grid)
        once = self.storage.unique and not self.storage.hidden
        samples = (self.storage.select if once else self.storage.shown)(list(e.matchers), own.start - self.storage.lookback_ms + 1, own.last, kind=of)
        rows = windows.instant(samples, self.storage.labels, own, self.storage.lookback_ms)
        return Vector(self.back(rows, e.at, e.offset, grid), self.storage.labels)

    def ranged(self, e: Selector | Subquery, grid: Grid, name: str, parameter: Column | None = None) -> Vector:
        own, _ = self.pinned(e.at, e.offset, grid)
        if isinstance(e, Selector):
            samples, labels = self.storage.select(list(e.matchers), own.start - e.window + 1, own.last, by_series=name in windows.WITH_PREVIOUS, every=name != "last_over_time"), self.storage.labels
        else:
            step = e.step or self.subquery_step
            start = ((own.start - e.window) // step + 1) * step
            if own.last < start:
                start = own.last // step * step
            inner = Grid(start, max(start, own.last), step)
            v = self.vector(e.expr, inner) if kind(e.expr) == "vector" else self.vector(Call("vector", (e.expr,)), inner)
            samples, labels = v.df.withColumnRenamed("step", "ts_ms"), v.labels
        rows = windows.over_range(samples, labels, own, e.window, name, parameter)
        v = Vector(self.back(rows, e.at, e.offset, grid), labels)
        return v if name == "last_over_time" else v.with_value(F.col("value"))

    def histograms(self, e: Expr, grid: Grid) -> Vector | None:
        """The histograms among an expression's results, None if it has none; vector() has its numbers."""
        if not self.storage.histograms:
            return None
        match e:
            case Selector():
                v = self.instant(e, grid, HIST)
                return Vector(v.df.drop("sample_ts"), v.labels)
            case Unary():
                v = self.histograms(e.expr, grid)
                return v if v is None or e.op == "+" else v.with_value(histograms.scaled(F.col("value"), F.lit(-1.0)))
            case Aggregate(op="sum" | "avg"):
                v = self.histograms(e.expr, grid)
                return v and self.unmixed(self.added(e, v), self.reduced(e, self.vector(e.expr, grid)))
            case Binary(op="*" | "/") if "scalar" in (kind(e.left), kind(e.right)):
                swapped = kind(e.left) == "scalar"
                v = self.histograms(e.right if swapped else e.left, grid)
                if v is None or (swapped and e.op == "/"):
                    return None
                df, s = self.beside(v.df, self.scalar(e.left if swapped else e.right, grid), "s")
                return Vector(df, v.labels).with_value(histograms.scaled(F.col("value"), s if e.op == "*" else ieee.divide(F.lit(1.0), s)))
            case Binary(op="+" | "-") if "scalar" not in (kind(e.left), kind(e.right)) and not e.matching.side:
                return self.combined(e, self.histograms(e.left, grid), self.histograms(e.right, grid))
            case Call(name="label_replace" | "label_join"):
                v = self.histograms(e.args[0], grid)
                return v and self.relabelled(e, v)
            case Call() if e.name in histograms.OVER_RANGE and isinstance(e.args[0], Selector):
                x = e.args[0]
                own, _ = self.pinned(x.at, x.offset, grid)
                samples = self.storage.select(list(x.matchers), own.start - x.window + 1, own.last, by_series=True, kind=HIST, every=e.name in ("sum_over_time", "avg_over_time"))
                rows = histograms.over_range(samples, self.storage.labels, own, x.window, e.name)
                v = Vector(self.back(rows, x.at, x.offset, grid), self.storage.labels)
                return v if e.name == "last_over_time" else v.with_value(F.col("value"))
        return None

    def added(self, e: Aggregate, v: Vector) -> Vector:
        names = self.grouping(e, v)
        found = histograms.added(v.df, ["step", *(column(n) for n in names)])
        value = F.col("value") if e.op == "sum" else histograms.scaled(F.col("value"), F.lit(1.0) / F.col("n"))
        return Vector(found.select("step", value.alias("value"), *(label(n) for n in names)), names)

    def unmixed(self, v: Vector, other: Vector) -> Vector:
        """Groups that `other` does not have: a group of numbers and histograms has no sum."""
        names = sorted({*v.labels, *other.labels})
        return Vector(self.set("unless", v, other, names, names).df, v.labels)

    def combined(self, e: Binary, left: Vector | None, right: Vector | None) -> Vector | None:
        """Sum or difference of the histograms with equal labels on both sides."""
        if left is None or right is None:
            return None
        names = sorted({*left.labels, *right.labels})
        keys = [x for x in names if (x in e.matching.labels if e.matching.on else x not in e.matching.labels and x != NAME)]
        rows = None
        for v, sign in ((left, 1.0), (right, -1.0 if e.op == "-" else 1.0)):
            own = v.having(sorted({*v.labels, *keys})).df.select("step", "value", F.lit(sign).alias("sign"), F.lit(sign if v is right else 0.0).alias("rights"), *(label(x) for x in keys))
            rows = own if rows is None else rows.unionByName(own)
        group = Window.partitionBy("step", *(label(x) for x in keys))
        sides = F.sum((F.col("rights") != 0).cast("int")).over(group), F.count("*").over(group)
        many = F.lit("found duplicate series for the match group; many-to-many matching not allowed")
        rows = rows.withColumns({"r": sides[0], "all": sides[1]}).where("r > 0 and all > r")
        rows = rows.withColumn("sign", F.when(F.col("all") > 2, F.raise_error(many).cast("double")).otherwise(F.col("sign")))
        found = histograms.added(rows, ["step", *(column(x) for x in keys)], F.col("sign"))
        return Vector(found.select("step", "value", *(label(x) for x in keys)), keys)

    def numbers(self, name: str, parameters: list[Expr], e: Expr, grid: Grid) -> Vector:
        """A number read from each histogram; numbers among the results of `e` do not count."""
        v = self.histograms(e, grid)
        if v is None:
            v = self.vector(e, grid)
            return Vector(v.df.where(F.lit(False)), v.labels).with_value(F.col("value"))
        df, given = v.df, []
        for i, p in enumerate(parameters):
            df, s = self.beside(df, self.scalar(p, grid), f"s{i}")
            given.append(s)
        return Vector(df, v.labels).with_value(histograms.NUMBERS[name](F.col("value"), *given))

    def either(self, a: Vector, b: Vector) -> Vector:
        names = sorted({*a.labels, *b.labels})
        return Vector(a.having(names).df.unionByName(b.having(names).df), names)

    def counted(self, e: Expr, grid: Grid) -> Vector:
        """Numbers, and 1 for each histogram, for what does not look at values."""
        v, h = self.vector(e, grid), self.histograms(e, grid)
        return v if h is None else self.either(v, h.with_value(F.lit(1.0), named=True))

    def call(self, e: Call, grid: Grid) -> Vector:
        name, args = e.name, e.args
        if name in histograms.NUMBERS:
            native = self.numbers(name, list(args[:-1]), args[-1], grid) if name != "histogram_quantile" or self.storage.histograms else None
            if name != "histogram_quantile":
                return native
            classic = self.histogram_quantile(args[0], self.vector(args[1], grid), grid)
            return classic if native is None else self.either(classic, native)
        if name in ("count_over_time", "present_over_time") and isinstance(args[0], Selector) and self.storage.histograms:
            each = Compiler(self.spark, self.storage.counted(), self.whole, self.subquery_step)
            return each.call(e, grid)
        if args and kind(args[0]) == "matrix" and name not in ("absent_over_time", "predict_linear"):
            return self.ranged(args[0], grid, name)
        match name:
            case "predict_linear" | "quantile_over_time":
                m, s = (args[0], args[1]) if name == "predict_linear" else (args[1], args[0])
                if not isinstance(s, (Number, Unary)):
                    raise QueryError(f"{name} takes a number as its parameter", "bad_request")
                number = s.value if isinstance(s, Number) else -s.expr.value
                return self.ranged(m, grid, name, F.lit(number) if name == "predict_linear" else number)
            case "absent_over_time":
                return self.absent(args[0], self.ranged(args[0], grid, "present_over_time"), grid)
            case "absent":
                return self.absent(args[0], self.counted(args[0], grid), grid)
            case "vector":
                df, s = self.beside(self.steps(grid), self.scalar(args[0], grid), "s")
                return Vector(df.select("step", s.cast("double").alias("value")), [])
            case "timestamp":
                if isinstance(args[0], Selector):
                    v = self.instant(args[0], grid)
                    return v.with_value(F.col("sample_ts") / 1000.0)
                return self.vector(args[0], grid).with_value(F.col("step") / 1000.0)
            case "sort" | "sort_desc":
                return self.vector(args[0], grid)  # order is a matter of the result, see Query.ordered
            case "label_replace" | "label_join":
                return self.relabelled(e, self.vector(args[0], grid))
        if not args:  # a part of the calendar, of the evaluation time
            return Vector(self.steps(grid).select("step", mapped(name, F.col("step") / 1000.0).alias("value")), [])
        v = self.vector(args[0], grid)
        df, more = v.df, []
        for i, a in enumerate(args[1:]):
            df, s = self.beside(df, self.scalar(a, grid), f"s{i}")
            more.append(s)
        return Vector(df, v.labels).with_value(mapped(name, F.col("value"), *more))

    def absent(self, e: Expr, v: Vector, grid: Grid) -> Vector:
        """1 at steps without any series, with the labels that equality matchers give."""
        matchers = e.matchers if isinstance(e, Selector) else ()
        equal = {m.name: m.value for m in matchers if m.op == "=" and m.name != NAME and m.value}
        equal = {n: x for n, x in equal.items() if sum(m.name == n for m in matchers) == 1}
        rows = self.steps(grid).join(v.df.select("step").distinct(), "step", "left_anti")
        return Vector(rows.select("step", F.lit(1.0).alias("value"), *(F.lit(x).alias(column(n)) for n, x in equal.items())), list(equal))

    def set_label(self, v: Vector, target: str, value: Column) -> Vector:
        if not re.fullmatch(r"[a-zA-Z_]\w*", target):
            raise QueryError(f"invalid destination label name: {target}", "bad_request")
        names = v.labels if target in v.labels else [*v.labels, target]
        return Vector(v.df.withColumn(column(target), value).select("step", "value", *(label(x) for x in names)), names)

    def relabelled(self, e: Call, v: Vector) -> Vector:
        if e.name == "label_replace":
            return self.label_replace(v, *(x.value for x in e.args[1:]))
        target, separator, *sources = (x.value for x in e.args[1:])
        joined = F.concat_ws(separator, *(F.coalesce(label(x), F.lit("")) if x in v.labels else F.lit("") for x in sources))
        return self.set_label(v, target, F.when(joined != "", joined))

    def label_replace(self, v: Vector, target: str, replacement: str, source: str, pattern: str) -> Vector:
        compiled = Pattern(pattern)
        anchored = compiled.anchored
        found = label(source) if source in v.labels else F.lit(None).cast("string")
        text = F.coalesce(found, F.lit(""))
        parts, at = [], 0
        for m in re.finditer(r"\$(?:(\d+)|\{(\w+)\}|([A-Za-z_]\w*)|\$)", replacement):
            parts.append(F.lit(replacement[at : m.start()]))
            ref = m.group(1) or m.group(2) or m.group(3)
            number = int(ref) if ref and ref.isdigit() else compiled.groups.get(ref, -1) if ref else None
            if number is None:
                parts.append(F.lit("$"))
            elif 0 <= number <= compiled.count:
                parts.append(F.coalesce(F.regexp_extract(text, anchored, number), F.lit("")))
            at = m.end()
        new = F.concat(*parts, F.lit(replacement[at:]))
        old = label(target) if target in v.labels else F.lit(None).cast("string")
        return self.set_label(v, target, F.when(text.rlike(anchored), F.when(new != "", new)).otherwise(old))

    def histogram_quantile(self, q: Expr, v: Vector, grid: Grid) -> Vector:
        """Of classic buckets: cumulative counts by the label le."""
        if "le" not in v.labels:
            return Vector(v.df.where(F.lit(False)).select("step", "value"), [])
        names = [x for x in v.labels if x not in ("le", NAME)]
        bound = F.when(label("le") == "+Inf", ieee.INF).otherwise(label("le").try_cast("double"))
        rows = v.df.withColumn("bound", bound).where("bound is not null").groupBy("step", *(label(x) for x in names), "bound").agg(F.sum("value").alias("value"))
        w = Window.partitionBy("step", *(label(x) for x in names)).orderBy("bound")
        rows = rows.withColumn("c", F.max("value").over(w)).withColumn("pc", F.coalesce(F.lag("c").over(w), F.lit(0.0))).withColumn("pb", F.lag("bound").over(w))
        all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows, s = self.beside(rows.withColumn("total", F.max("c").over(all_)).withColumn("top", F.max("bound").over(all_)), self.scalar(q, grid), "q")
        rank = s * F.col("total")
        low = F.coalesce("pb", F.when(F.col("bound") > 0, 0.0).otherwise(F.col("bound")))
        inside = F.when(F.col("bound") == ieee.INF, F.coalesce("pb", F.lit(ieee.NAN))).otherwise(low + (F.col("bound") - low) * ieee.divide(rank - F.col("pc"), F.col("c") - F.col("pc")))
        first = rows.withColumn("hit", (F.col("c") >= rank)).groupBy("step", *(label(x) for x in names)).agg(
            F.min_by(F.when(F.col("hit"), inside), F.when(F.col("hit"), F.col("bound"))).alias("v"), F.max("total").alias("total"), F.max("top").alias("top"), F.max(s).alias("qq"))
        value = F.when((F.col("top") != ieee.INF) | (F.col("total") == 0) | F.isnan("qq"), ieee.NAN).when(F.col("qq") < 0, -ieee.INF).when(F.col("qq") > 1, ieee.INF).otherwise(F.col("v"))
        return Vector(first.select("step", value.alias("value"), *(label(x) for x in names)), names)

    @staticmethod
    def grouping(e: Aggregate, v: Vector) -> list[str]:
        return [x for x in v.labels if x not in e.labels and x != NAME] if e.without else [x for x in v.labels if x in e.labels]

    def aggregate(self, e: Aggregate, grid: Grid) -> Vector:
        v = self.counted(e.expr, grid) if e.op in ("count", "group") else self.vector(e.expr, grid)
        out = self.reduced(e, v, grid)
        if e.op in ("sum", "avg") and (h := self.histograms(e.expr, grid)) is not None:
            return self.unmixed(out, self.added(e, h))
        return out

    def reduced(self, e: Aggregate, v: Vector, grid: Grid | None = None) -> Vector:
        """An aggregation of numbers; the grid is needed for parameters."""
        names = self.grouping(e, v)
        keys, x = [label(n) for n in names], F.col("value")
        if e.op in ("topk", "bottomk"):
            df, k = self.beside(v.df, self.scalar(e.parameter, grid), "k")
            first = F.when(F.isnan("value"), 1).otherwise(0)
            rank = F.row_number().over(Window.partitionBy("step", *keys).orderBy(first, x.desc() if e.op == "topk" else x.asc(), *v.keys()))
            return Vector(df.withColumn("k", k.cast("double")).withColumn("rank", rank).where("not isnan(k) and rank <= floor(k)").select("step", "value", *v.keys()), v.labels)
        if e.op == "count_values":
            target = e.parameter.value
            names = [n for n in names if n != target]
            rows = v.df.withColumn("text", ieee.text(x)).groupBy("step", *(label(n) for n in names), "text").agg(F.count("*").cast("double").alias("value"))
            return Vector(rows.select("step", "value", *(label(n) for n in names), F.col("text").alias(column(target))), [*names, target])
        df, parameter = v.df, None
        if e.op == "quantile":
            parameter = e.parameter.value if isinstance(e.parameter, Number) else None
            if parameter is None:
                df, parameter = self.beside(df, self.scalar(e.parameter, grid), "q")
        one = {
            "sum": lambda: F.sum(x), "avg": lambda: ieee.mean(x), "count": lambda: F.count("*").cast("double"), "min": lambda: ieee.least(x), "max": lambda: ieee.greatest(x), "group": lambda: F.max(F.lit(1.0)),
            "stddev": lambda: F.when(F.max(F.isnan(x) | (F.abs(x) == ieee.INF)), ieee.NAN).otherwise(F.stddev_pop(x)), "stdvar": lambda: F.when(F.max(F.isnan(x) | (F.abs(x) == ieee.INF)), ieee.NAN).otherwise(F.var_pop(x)),
            "quantile": lambda: ieee.quantile(x, parameter),
        }[e.op]()
        return Vector(df.groupBy("step", *keys).agg(one.alias("value")).select("step", "value", *keys), names)

    def binary(self, e: Binary, grid: Grid) -> Vector:
        if "scalar" in (kind(e.left), kind(e.right)):
            swapped = kind(e.left) == "scalar"
            v = self.vector(e.right if swapped else e.left, grid)
            df, s = self.beside(v.df, self.scalar(e.left if swapped else e.right, grid), "s")
            a, b = (s, F.col("value")) if swapped else (F.col("value"), s)
            v = Vector(df, v.labels)
            if e.op not in COMPARISONS:
                return v.with_value(ieee.ARITHMETIC[e.op](a, b))
            hit = ieee.compare(e.op, a, b)
            return v.with_value(hit.cast("double")) if e.boolean else Vector(df.where(hit).select("step", "value", *v.keys()), v.labels)
        left, right = self.vector(e.left, grid), self.vector(e.right, grid)
        names = sorted(set(left.labels) | set(right.labels))
        keys = [x for x in names if (x in e.matching.labels if e.matching.on else x not in e.matching.labels and x != NAME)]
        if e.op in ("and", "or", "unless"):
            return self.set(e.op, left, right, names, keys)
        return self.matched(e, left, right, keys)

    @staticmethod
    def equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
        """Equal steps and keys; null keys equal each other."""
        return reduce(Column.__and__, [a[f"`{column(x)}`"].eqNullSafe(b[f"`k_{x}`"]) for x in keys], a["step"] == b["k_step"])

    @staticmethod
    def keyed(v: Vector, keys: list[str]) -> list[Column]:
        return [F.col("step").alias("k_step"), *((label(x) if x in v.labels else F.lit(None).cast("string")).alias(f"k_{x}") for x in keys)]

    def set(self, op: str, left: Vector, right: Vector, names: list[str], keys: list[str]) -> Vector:
        a, b = left.having(names), right.having(names)
        if op in ("and", "unless"):
            other = b.df.select(*self.keyed(b, keys)).distinct()
            return Vector(a.df.join(other, self.equal(a.df, other, keys), "left_semi" if op == "and" else "left_anti").select("step", "value", *left.keys()), left.labels)
        other = a.df.select(*self.keyed(a, keys)).distinct()
        return Vector(a.df.unionByName(b.df.join(other, self.equal(b.df, other, keys), "left_anti")), names)

    def matched(self, e: Binary, left: Vector, right: Vector, keys: list[str]) -> Vector:
        """Many to one or one to one: the one side is checked to be unique, the many side keeps its labels."""
        m: Matching = e.matching
        many, one = (right, left) if m.side == "right" else (left, right)
        include = list(m.include)
        unique = F.when(F.count("*") > 1, F.raise_error(F.lit("found duplicate series for the match group on the one side of the operation; many-to-many matching not allowed")).cast("double")).otherwise(F.max("value"))
        carried = [(F.max(label(x)) if x in one.labels else F.lit(None).cast("string")).alias(f"i_{x}") for x in include]
        other = one.df.select("value", *self.keyed(one, keys), *(label(x) for x in one.labels)).groupBy("k_step", *(F.col(f"`k_{x}`") for x in keys)).agg(unique.alias("other"), *carried)
        a = many.having(sorted({*many.labels, *keys}))
        rows = a.df.join(other, self.equal(a.df, other, keys))
        x, y = (F.col("other"), F.col("value")) if m.side == "right" else (F.col("value"), F.col("other"))
        compares = e.op in COMPARISONS
        keep_name = compares and not e.boolean
        if compares:
            hit = ieee.compare(e.op, x, y)
            # a filter keeps the left side's values
            value = hit.cast("double") if e.boolean else x
            rows = rows if e.boolean else rows.where(hit)
        else:
            value = ieee.ARITHMETIC[e.op](x, y)
        base = many.labels
        if not m.side and m.on:
            base = [k for k in many.labels if k in keys]
        elif not m.side:
            base = [n for n in many.labels if n not in m.labels]
        names = [n for n in base if (keep_name and not (m.on and not m.side)) or n != NAME or (m.on and NAME in keys and not m.side)]
        out = {n: label(n) for n in names} | {n: F.col(f"`i_{n}`") for n in include}
        result = Vector(rows.select("step", value.alias("value"), *(c.alias(column(n)) for n, c in out.items())), list(out))
        if m.side:
            return result
        # one to one: the left side has to be unique, too
        n = Window.partitionBy("step", *result.keys())
        checked = F.when(F.count("*").over(n) > 1, F.raise_error(F.lit("multiple matches for labels: many-to-one matching must be explicit (group_left/group_right)")).cast("double")).otherwise(F.col("value"))
        return Vector(result.df.withColumn("value", checked), result.labels)


@dataclass
class Query:
    """A compiled query: kind is vector, scalar or matrix; histograms: the results that are histograms, if there can be any."""

    kind: str
    df: DataFrame
    labels: list[str]
    order: str = ""
    histograms: Vector | None = None

    def ordered(self) -> DataFrame:
        by = {"sort": F.col("value").asc(), "sort_desc": F.col("value").desc()}.get(self.order)
        return self.df.select("step", "value", *(label(x) for x in self.labels)).orderBy("step", *([by] if by is not None else []), *(label(x).asc_nulls_first() for x in self.labels))


def compile_query(storage: Storage, text: str, grid: Grid, subquery_step: int = 60_000) -> Query:
    e = parse(text)
    compiler = Compiler(storage.samples.sparkSession, storage, grid, subquery_step)
    if isinstance(e, String):
        raise QueryError("string results have no samples", "bad_request")
    if kind(e) == "matrix":
        if not (isinstance(e, Selector) and grid.start == grid.last):
            raise QueryError("invalid expression type range vector for range query, must be scalar or instant vector")
        own = Grid.instant(grid.start - e.offset)
        rows = storage.select(list(e.matchers), own.start - e.window + 1, own.start).where("not is_stale")
        shown = ("value", *(label(x) for x in storage.labels))
        found = None
        if storage.histograms:
            other = storage.select(list(e.matchers), own.start - e.window + 1, own.start, kind=HIST).where("not is_stale")
            found = Vector(other.select(F.col("ts_ms").alias("step"), *shown), storage.labels)
        return Query("matrix", rows.select(F.col("ts_ms").alias("step"), *shown), storage.labels, histograms=found)
    if kind(e) == "scalar":
        v = compiler.vector(Call("vector", (e,)), grid)
        return Query("scalar", v.df, [])
    v = compiler.vector(e, grid)
    return Query("vector", v.df, v.labels, e.name if isinstance(e, Call) and e.name in ("sort", "sort_desc") else "", compiler.histograms(e, grid))
