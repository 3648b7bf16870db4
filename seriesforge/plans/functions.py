"""Functions of the query language: argument kinds, and Spark expressions for those that map values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ieee

_MAPS = {
    "abs": F.abs, "ceil": lambda v: _whole(v, F.ceil), "floor": lambda v: _whole(v, F.floor), "exp": F.exp, "sqrt": lambda v: F.when(v < 0, ieee.NAN).otherwise(F.sqrt(v)),
    "ln": lambda v: _log(v, 1.0), "log2": lambda v: _log(v, math.log(2)), "log10": lambda v: F.when(v > 0, F.log10(v)).otherwise(_log(v, 1.0)),
    "sgn": lambda v: F.when(F.isnan(v), ieee.NAN).otherwise(F.signum(v)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": lambda v: v * (180 / math.pi), "rad": lambda v: v * (math.pi / 180),
}
OVER_TIME = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "last", "present"}
_RANGES = {f"{x}_over_time" for x in OVER_TIME} | {"rate", "increase", "delta", "irate", "idelta", "changes", "resets", "deriv", "absent_over_time"}
_CALENDAR = {"minute", "hour", "day_of_week", "day_of_month", "day_of_year", "days_in_month", "month", "year"}

#: Kinds of arguments, and how many of the last may be missing.
SIGNATURES: dict[str, tuple[tuple[str, ...], int]] = (
    {x: (("vector",), 0) for x in (*_MAPS, "timestamp", "absent", "sort", "sort_desc", "scalar")}
    | {x: (("matrix",), 0) for x in _RANGES}
    | {x: (("vector",), 1) for x in _CALENDAR}
    | {"time": ((), 0), "pi": ((), 0), "vector": (("scalar",), 0), "round": (("vector", "scalar"), 1), "clamp": (("vector", "scalar", "scalar"), 0)}
    | {"clamp_min": (("vector", "scalar"), 0), "clamp_max": (("vector", "scalar"), 0), "quantile_over_time": (("scalar", "matrix"), 0), "predict_linear": (("matrix", "scalar"), 0)}
    | {f"histogram_{x}": (("vector",), 0) for x in ("count", "sum", "avg", "stddev", "stdvar")}
    | {"histogram_fraction": (("scalar", "scalar", "vector"), 0), "histogram_quantile": (("scalar", "vector"), 0), "label_replace": (("vector", *["string"] * 4), 0), "label_join": (("vector", *["string"] * 12), 10)}
)


def _whole(v: Column, f) -> Column:
    wide = F.isnan(v) | (F.abs(v) >= 2.0**52)
    return F.when(wide, v).otherwise(f(F.when(~wide, v)).cast("double"))


def _log(v: Column, base: float) -> Column:
    return F.when(v == 0, -ieee.INF).when((v < 0) | F.isnan(v), ieee.NAN).otherwise(F.log(v) / base)


def mapped(name: str, v: Column, *more: Column) -> Column | None:
    """Value of a function that maps values; None for other functions."""
    if name in _MAPS:
        return _MAPS[name](v)
    if name == "round":
        inverse = ieee.divide(F.lit(1.0), more[0] if more else F.lit(1.0))
        return ieee.divide(_whole(v * inverse + 0.5, F.floor), inverse)
    if name == "clamp":
        return F.when(F.isnan(v) | F.isnan(more[0]) | F.isnan(more[1]), ieee.NAN).otherwise(F.greatest(more[0], F.least(more[1], v)))
    if name in ("clamp_min", "clamp_max"):
        return F.when(F.isnan(v) | F.isnan(more[0]), ieee.NAN).otherwise((F.greatest if name == "clamp_min" else F.least)(v, more[0]))
    if name in _CALENDAR:
        return calendar(name, v)
    return None


def calendar(name: str, seconds: Column) -> Column:
    """Part of a UTC time, by day numbers; the session's zone does not matter."""
    s = F.floor(seconds).cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    part = {
        "minute": lambda: F.floor(F.pmod(s, F.lit(3600)) / 60), "hour": lambda: F.floor(F.pmod(s, F.lit(86400)) / 3600), "day_of_week": lambda: F.dayofweek(day) - 1, "day_of_month": lambda: F.dayofmonth(day),
        "day_of_year": lambda: F.dayofyear(day), "days_in_month": lambda: F.dayofmonth(F.last_day(day)), "month": lambda: F.month(day), "year": lambda: F.year(day),
    }[name]()
    return F.when(F.isnan(seconds), ieee.NAN).otherwise(part.cast("double"))
