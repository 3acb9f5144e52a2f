"""Graph-query functions by name, as column builders.

Names are looked up without regard to case. An unknown name gives null, or raises in strict mode.
Every function gives null for a null argument unless its line says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def _guard(bad: Column, message: str, value: Column) -> Column:
    """``value``, but an error where ``bad`` holds (Spark itself gives null or NaN there)."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def range_(start: Column, end: Column, step: Column | None = None) -> Column:
    """Whole numbers from start to before end: end-exclusive, also downwards; empty if there are none."""
    step = F.lit(1) if step is None else step
    start, end, step = (x.cast("long") for x in (start, end, step))
    up = F.sequence(start, F.greatest(end - 1, start), F.greatest(step, F.lit(1).cast("long")))
    down = F.sequence(start, F.least(end + 1, start), F.least(step, F.lit(-1).cast("long")))
    none = F.array().cast("array<bigint>")
    out = F.when((step > 0) & (start < end), up).when((step < 0) & (start > end), down).when(step == 0, F.raise_error(F.lit("range step is zero")).cast("array<bigint>")).otherwise(none)
    return F.when(start.isNotNull() & end.isNotNull() & step.isNotNull(), out)


def head(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def tail(a: Column) -> Column:
    """All but the first; empty for none or one."""
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def size(x: Column, kind: str = "array") -> Column:
    """Of a list, a map or a string (kind "string")."""
    return F.length(x) if kind == "string" else F.when(x.isNotNull(), F.size(x))


def log(x: Column) -> Column:
    """Natural logarithm; zero and below raise."""
    return _guard(x <= 0, "log of a number that isn't positive", F.ln(x))


def log10(x: Column) -> Column:
    return _guard(x <= 0, "log10 of a number that isn't positive", F.log10(x))


def sqrt(x: Column) -> Column:
    return _guard(x < 0, "square root of a negative number", F.sqrt(x))


def asin(x: Column) -> Column:
    """Beyond [-1, 1] it raises."""
    return _guard(F.abs(x) > 1, "asin of a number beyond 1", F.asin(x))


def acos(x: Column) -> Column:
    return _guard(F.abs(x) > 1, "acos of a number beyond 1", F.acos(x))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From the 0-based ``start``, to the end or ``length`` characters."""
    return F.substring(s, start + 1, F.length(s) if length is None else length)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


FUNCTIONS: dict[str, Builder] = {
    "range": range_, "head": head, "last": last, "tail": tail, "reverse": F.reverse, "size": size, "length": F.length,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": asin, "acos": acos, "atan": F.atan, "atan2": F.atan2,
    "log": log, "log10": log10, "exp": F.exp, "sqrt": sqrt, "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "sign": F.signum,
    "pi": F.pi, "e": F.e, "point": point, "distance": haversine_km,
    "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "replace": F.replace, "split": F.split, "substring": substring,
    "left": lambda s, n: F.left(s, n), "right": lambda s, n: F.right(s, n), "contains": lambda a, b: a.contains(b), "starts_with": lambda a, b: a.startswith(b), "ends_with": lambda a, b: a.endswith(b),
    "tointeger": lambda x: x.cast("double").cast("long"), "tofloat": lambda x: x.cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.cast("boolean"),
    "coalesce": F.coalesce, "keys": F.map_keys,
}

AGGREGATES: dict[str, Builder] = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list, "stdev": F.stddev_samp, "sum_values": F.sum, "min_value": F.min, "max_value": F.max}


def call(name: str, *args: Column, strict: bool = False) -> Column:
    """The function's column; an unknown name gives null, or a KeyError if ``strict``."""
    key = name.lower()
    found = FUNCTIONS.get(key) or AGGREGATES.get(key)
    if found is None:
        if strict:
            raise KeyError(f"no function {name}")
        return F.lit(None)
    return found(*args)
