"""Declarative transformations: a list of {"type": ...} steps folded into one plan."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources import io

#: Words that an expression may not have.
FORBIDDEN = re.compile(r"\b(exec|eval|import|compile|java_method|reflect|try_reflect)\b", re.I)


class StepError(ValueError):
    """A step that isn't known or lacks what it needs."""


def _safe(expression: str) -> str:
    if FORBIDDEN.search(expression):
        raise StepError(f"the expression isn't allowed: {expression}")
    return expression


def _normalise(df: DataFrame, s: dict[str, Any]) -> DataFrame:
    """Numbers to [0, 1] by their range, texts trimmed and lowered."""
    numbers = [c for c in s["columns"] if dict(df.dtypes)[c] in ("int", "bigint", "double", "float", "smallint")]
    out = df
    if numbers:
        m = df.agg(*(F.min(c).alias(f"__a{i}") for i, c in enumerate(numbers)), *(F.max(c).alias(f"__b{i}") for i, c in enumerate(numbers)))
        out = df.crossJoin(F.broadcast(m))  # one row
        for i, c in enumerate(numbers):
            out = out.withColumn(c, F.coalesce(F.try_divide((F.col(c) - F.col(f"__a{i}")).cast("double"), F.col(f"__b{i}") - F.col(f"__a{i}")), F.lit(0.0)))
    for c in s["columns"]:
        if c not in numbers:
            out = out.withColumn(c, F.lower(F.trim(c)))
    return out.select(*df.columns)


def _chunk(df: DataFrame, s: dict[str, Any]) -> DataFrame:
    pieces = T.chunks(F.col(s["column"]), s.get("strategy", "fixed_size"), s.get("size", 1000), s.get("overlap", 100), s.get("most"))
    return df.select(*(c for c in df.columns if c != s["column"]), F.posexplode(pieces).alias("chunk", s["column"]))


STEPS: dict[str, Callable[[DataFrame, dict[str, Any]], DataFrame]] = {
    "filter": lambda df, s: df.filter(_safe(s["condition"])),
    "map": lambda df, s: df.withColumn(s["column"], F.expr(_safe(s["expression"]))),
    "select": lambda df, s: df.select(*s["columns"]),
    "drop": lambda df, s: df.drop(*s["columns"]),
    "rename": lambda df, s: df.withColumnsRenamed(s["columns"]),
    "shuffle": lambda df, s: df.orderBy(F.rand(s.get("seed", 0))),
    "sort": lambda df, s: df.orderBy(*(F.col(c).desc_nulls_last() if s.get("descending") else F.col(c).asc_nulls_last() for c in s["columns"])),
    "limit": lambda df, s: df.limit(s["n"]),
    "distinct": lambda df, s: df.dropDuplicates(s["columns"]) if s.get("columns") else df.distinct(),
    "normalize": _normalise,
    "flatten": lambda df, s: io.flatten(df, s.get("separator", "_")),
    "chunk": _chunk,
    "sample": lambda df, s: df.sample(s["fraction"], s.get("seed", 0)),
    "aggregate": lambda df, s: df.groupBy(*s.get("by", [])).agg(*(F.expr(_safe(e)).alias(n) for n, e in s["values"].items())),
    "validate_schema": lambda df, s: _validate(df, s),
}


def _validate(df: DataFrame, s: dict[str, Any]) -> DataFrame:
    have = dict(df.dtypes)
    wrong = {c: t for c, t in s["schema"].items() if have.get(c) != t}
    if wrong:
        raise StepError(f"the schema differs: {wrong}")
    return df


def process(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """The steps in order. Nothing runs until the result is asked for."""
    for i, s in enumerate(steps):
        if not isinstance(s, dict) or s.get("type") not in STEPS:
            raise StepError(f"step {i} isn't known: {s!r}")
        try:
            df = STEPS[s["type"]](df, s)
        except KeyError as e:
            raise StepError(f"step {i} ({s['type']}) lacks {e}") from e
    return df


class Pipeline:
    """Named stages; a stage that raises ends the run, and its name and error are the result."""

    def __init__(self, *stages: tuple[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.stages = stages

    def then(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(*self.stages, (name, f))

    def run(self, df: DataFrame) -> tuple[DataFrame | None, str | None]:
        for name, f in self.stages:
            try:
                df = df.transform(f)
            except Exception as e:  # noqa: BLE001  carried to the caller
                return None, f"{name}: {e}"
        return df, None
