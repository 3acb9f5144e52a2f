"""The operator IR: a list of steps over a graph, with budgets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import Graph


class BudgetExceeded(RuntimeError):
    """A step went beyond its budget."""


@dataclass(frozen=True)
class Budgets:
    """Most hops, working-set rows, edges kept per node, and results."""

    max_depth: int = 3
    max_working_set: int = 50_000
    max_degree: int = 10_000
    max_results: int = 100


#: Fixed names of the presets; "default" is "safe".
PRESETS = {"safe": Budgets(), "default": Budgets(), "strict": Budgets(max_depth=2, max_working_set=5_000, max_degree=1_000, max_results=50), "debug": Budgets(max_depth=10, max_working_set=1_000_000, max_degree=100_000, max_results=10_000)}


def preset(name: str | None = None, **changes: int) -> Budgets:
    """The named budgets with changes; an unknown name raises."""
    key = name or "safe"
    if key not in PRESETS:
        raise ValueError(f"no budget preset {name!r}")
    return replace(PRESETS[key], **changes)


@dataclass(frozen=True)
class SeedEntities:
    ids: tuple[str, ...]


@dataclass(frozen=True)
class ScanType:
    label: str
    limit: int | None = None


@dataclass(frozen=True)
class Expand:
    types: tuple[str, ...] | None = None
    direction: str = "out"
    max_per_node: int | None = None


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Project:
    fields: tuple[str, ...] = ("id", "type", "name")


@dataclass(frozen=True)
class QueryIR:
    ops: tuple = field(default_factory=tuple)

    @staticmethod
    def from_ops(ops) -> QueryIR:
        return QueryIR(tuple(ops))

    def add(self, op) -> QueryIR:
        return QueryIR((*self.ops, op))


def execute(graph: Graph, query: QueryIR, budgets: Budgets | None = None) -> DataFrame:
    """The nodes that the steps end at. Limits are in order of id, so that results repeat.

    Without ``budgets`` nothing is counted and the plan stays lazy; with them each hop is counted, and
    one beyond its budget raises.
    """
    now: DataFrame | None = None
    fields: tuple[str, ...] | None = None
    hops = 0
    for op in query.ops:
        if isinstance(op, SeedEntities):
            now = graph.seeds(list(op.ids)).select("id")
        elif isinstance(op, ScanType):
            found = graph.scan(op.label).select("id")
            now = found if op.limit is None else found.orderBy("id").limit(op.limit)
        elif now is None:
            raise ValueError("a query starts with SeedEntities or ScanType")
        elif isinstance(op, Expand):
            hops += 1
            if budgets and hops > budgets.max_depth:
                raise BudgetExceeded(f"more than {budgets.max_depth} hops")
            cap = op.max_per_node if op.max_per_node is not None else budgets.max_degree if budgets else None
            now = graph.expand(now, list(op.types) if op.types else None, op.direction, cap).select(F.col("dst").alias("id")).distinct()
        elif isinstance(op, Limit):
            now = now.orderBy("id").limit(op.n)
        elif isinstance(op, Project):
            fields = op.fields
        else:
            raise ValueError(f"no such step: {op!r}")
        if budgets and not isinstance(op, Project) and now.limit(budgets.max_working_set + 1).count() > budgets.max_working_set:
            raise BudgetExceeded(f"more than {budgets.max_working_set} nodes at work")
    if now is None:
        raise ValueError("an empty query")
    full = graph.headers(now).withColumn("type", F.element_at("labels", 1))
    out = full.select(*(fields or ("id", "type", "name")))
    return out.orderBy("id").limit(budgets.max_results) if budgets and "id" in out.columns else out


def page(df: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """Rows number * size and following, by key: a page of a result."""
    return df.orderBy(key).offset(number * size).limit(size)
