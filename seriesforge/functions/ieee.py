"""Floating-point semantics of queries on Spark columns: division by zero, NaN order and equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b).otherwise(F.lit(1.0)))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(a % F.when(b != 0, b).otherwise(F.lit(1.0)))


def power(a: Column, b: Column) -> Column:
    return F.when((a == 1) | ((a == -1) & (F.abs(b) == INF)), 1.0).otherwise(F.pow(a, b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": power, "atan2": F.atan2}


def compare(op: str, a: Column, b: Column) -> Column:
    nan = F.isnan(a) | F.isnan(b)
    plain = {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return (nan | plain) if op == "!=" else (~nan & plain)


def least(v: Column) -> Column:
    """Aggregate: minimum, NaN only if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, NAN))


def greatest(v: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, NAN))


def mean(v: Column) -> Column:
    """Aggregate: a mean that stays finite when only the sum overflows."""
    scaled = F.avg(v / 2.0**64) * 2.0**64
    return F.when((F.abs(F.sum(v)) == INF) & (F.max(F.when(F.abs(v) == INF, 1)).isNull()), scaled).otherwise(F.avg(v))


def quantile(v: Column, q: Column | float) -> Column:
    """Aggregate: linear between ranks; outside 0..1 infinite."""
    if isinstance(q, (int, float)):
        if q != q:
            return F.max(F.lit(NAN))
        if not 0 <= q <= 1:
            return F.max(F.lit(INF if q > 1 else -INF))
        return F.percentile(v, F.lit(float(q)))
    values = F.sort_array(F.collect_list(v))  # a quantile that differs by step
    q = F.max(q)
    n = F.size(values)
    rank = q * (n - 1)
    low = F.greatest(F.lit(0), F.least(F.floor(rank), n - 1)).cast("int")
    high = F.least(low + 1, n - 1).cast("int")
    inside = F.element_at(values, low + 1) * (1 - (rank - low)) + F.element_at(values, high + 1) * (rank - low)
    return F.when(F.isnan(q), NAN).when(q < 0, -INF).when(q > 1, INF).otherwise(inside)


def text(v: Column) -> Column:
    """Shortest decimal form without an exponent."""
    plain = v.cast("string")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    wide = F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(v), "NaN").when(v == INF, "+Inf").when(v == -INF, "-Inf").when(whole, F.when(whole, v).cast("bigint").cast("string")).when(plain.contains("E") & (F.abs(v) < 1e19), wide).otherwise(plain)
