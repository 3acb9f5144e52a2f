"""Clauses that change a graph: CREATE, MERGE, SET, REMOVE, DELETE. Each gives a new graph; no table is changed in place.

Nodes are told apart by their property id, which CREATE and MERGE must state; edges by their ends and type.
Expressions see values as they were matched. Rows are changed by equality joins on these keys.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import Graph
from millrace.plans.cypher import Compiler, CypherError, NodePattern, Parser
from millrace.shared import write_table

EDGE = ("src", "dst", "type")


class WriteParser(Parser):
    def statement(self) -> tuple[list, list]:
        """The clauses that read, and those that write."""
        reads: list = []
        writes: list = []
        while self.now.kind != "end":
            if not writes and self.word("OPTIONAL", "MATCH"):
                reads.append(("match", True, self.patterns(), self.where()))
            elif not writes and self.word("MATCH"):
                reads.append(("match", False, self.patterns(), self.where()))
            elif self.word("CREATE"):
                writes.append(("create", self.patterns()))
            elif self.word("MERGE"):
                path = self.path()
                on: dict[str, list] = {"CREATE": [], "MATCH": []}
                while self.word("ON"):
                    when = self.name().upper()
                    if when not in on or not self.word("SET"):
                        raise CypherError(f"expected ON CREATE SET or ON MATCH SET at {self.now.at}")
                    on[when] += self.changes()
                writes.append(("merge", path, on))
            elif self.word("SET"):
                writes.append(("set", self.changes()))
            elif self.word("REMOVE"):
                writes.append(("remove", self.targets()))
            elif self.word("DETACH", "DELETE"):
                writes.append(("delete", self.names(), True))
            elif self.word("DELETE"):
                writes.append(("delete", self.names(), False))
            else:
                raise CypherError(f"expected a clause at {self.now.at}, found {self.now.text!r}")
        if not writes:
            raise CypherError("nothing is written")
        return reads, writes

    def changes(self) -> list[tuple[str, str, Any]]:
        out = []
        while True:
            var = self.name()
            if self.sign(":"):
                out.append((var, ":", self.name()))
            else:
                self.need(".")
                key = self.name()
                self.need("=")
                out.append((var, key, self.expr()))
            if not self.sign(","):
                return out

    def targets(self) -> list[tuple[str, bool, str]]:
        out = []
        while True:
            var = self.name()
            label = self.sign(":")
            if not label:
                self.need(".")
            out.append((var, label, self.name()))
            if not self.sign(","):
                return out

    def names(self) -> list[str]:
        out = [self.name()]
        while self.sign(","):
            out.append(self.name())
        return out


class Writer:
    def __init__(self, graph: Graph, params: dict[str, Any]) -> None:
        self.graph, self.params = graph, params

    def col(self, e: Any, df: DataFrame):
        return Compiler(self.graph, self.params, False).col(e, df)

    def is_edge(self, df: DataFrame, var: str) -> bool:
        if var not in df.columns:
            raise CypherError(f"no variable {var}")
        return set(EDGE) <= set(df.schema[var].dataType.names)

    def update(self, df: DataFrame, var: str, column: str, value) -> None:
        """Sets a column of the nodes or edges that ``var`` is bound to."""
        edge = self.is_edge(df, var)
        keys = EDGE if edge else ("id",)
        own = F.col(f"`{var}`")
        new = df.filter(own.isNotNull()).select(*(own.getField(k).alias(k) for k in keys), value.alias("__new"), F.lit(True).alias("__hit")).dropDuplicates(list(keys))
        table = self.graph.edges if edge else self.graph.nodes
        if column not in table.columns:
            table = table.withColumn(column, F.lit(None).cast(new.schema["__new"].dataType))
        names = table.columns
        joined = table.join(new, list(keys), "left")
        table = joined.withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(f"`{column}`"))).select(*names)
        self.graph = Graph(self.graph.nodes, table) if edge else Graph(table, self.graph.edges)

    def set(self, df: DataFrame, changes: list) -> None:
        for var, key, e in changes:
            if key == ":":
                self.update(df, var, "labels", F.array_union(F.col(f"`{var}`").getField("labels"), F.array(F.lit(e))))
            elif key in ("id", *EDGE):
                raise CypherError(f"{key} can't be changed")
            else:
                self.update(df, var, key, self.col(e, df))

    def new_nodes(self, df: DataFrame, p: NodePattern) -> DataFrame:
        if "id" not in p.properties:
            raise CypherError(f"the new node {p.name} needs an id")
        props = [self.col(e, df).alias(k) for k, e in p.properties.items() if k != "id"]
        return df.select(self.col(p.properties["id"], df).alias("id"), F.array(*(F.lit(x) for x in p.labels)).cast("array<string>").alias("labels"), *props).dropDuplicates(["id"])

    def path(self, df: DataFrame, parts: list, merge: bool) -> tuple[DataFrame, list[str]]:
        """df with the path's new nodes bound, once they and the path's edges are in the graph; and the ids' columns."""
        before = set(df.columns)
        for p in parts[::2]:
            if p.name in df.columns:
                continue
            new = self.new_nodes(df, p)
            taken = new.join(self.graph.nodes.select("id"), "id", "left_semi")
            if not merge and not taken.isEmpty():
                raise CypherError("a node with this id is there already")
            fresh = new.join(self.graph.nodes.select("id"), "id", "left_anti")
            self.graph = Graph(self.graph.nodes.unionByName(fresh, allowMissingColumns=True), self.graph.edges)
            bound = self.graph.nodes.select(F.struct("*").alias(p.name))
            df = df.withColumn("__id", self.col(p.properties["id"], df)).join(bound, F.col("__id") == F.col(f"`{p.name}`").getField("id")).drop("__id")
        for i, rel in enumerate(parts[1::2]):
            if len(rel.types) != 1 or rel.direction == "both" or (rel.low, rel.high) != (1, 1):
                raise CypherError("a new edge has one type and one direction")
            a, b = parts[2 * i].name, parts[2 * i + 2].name
            src, dst = (a, b) if rel.direction == "out" else (b, a)
            new = df.select(F.col(f"`{src}`").getField("id").alias("src"), F.col(f"`{dst}`").getField("id").alias("dst"), F.lit(rel.types[0]).alias("type"))
            if merge:
                new = new.distinct().join(self.graph.edges, list(EDGE), "left_anti")
            self.graph = Graph(self.graph.nodes, self.graph.edges.unionByName(new, allowMissingColumns=True))
        return df, [c for c in df.columns if c not in before]

    def merge(self, df: DataFrame, parts: list, on: dict[str, list]) -> DataFrame:
        old = self.graph
        df, made = self.path(df, parts, merge=True)
        if any(on.values()):
            df = write_table(df, "merged")
        for when, changes in on.items():
            for change in changes:
                var = change[0]
                if var not in made:
                    raise CypherError(f"{var} isn't merged here")
                there = old.nodes.select(F.col("id").alias("__old"))
                hit = df.join(there, F.col(f"`{var}`").getField("id") == F.col("__old"), "left_semi" if when == "MATCH" else "left_anti")
                self.set(hit, [change])
        return df

    def remove(self, df: DataFrame, targets: list) -> None:
        for var, label, name in targets:
            own = F.col(f"`{var}`")
            if label:
                self.update(df, var, "labels", F.array_remove(own.getField("labels"), name))
            elif name in df.schema[var].dataType.names:
                self.update(df, var, name, F.lit(None).cast(df.schema[var].dataType[name].dataType))

    def delete(self, df: DataFrame, names: list[str], detach: bool) -> None:
        for var in names:
            own = F.col(f"`{var}`")
            if self.is_edge(df, var):
                gone = df.filter(own.isNotNull()).select(*(own.getField(k).alias(k) for k in EDGE)).distinct()
                self.graph = Graph(self.graph.nodes, self.graph.edges.join(gone, list(EDGE), "left_anti").select(*self.graph.edges.columns))
        for var in names:
            if not self.is_edge(df, var):
                ids = df.filter(F.col(f"`{var}`").isNotNull()).select(F.col(f"`{var}`").getField("id").alias("id"))
                self.graph = self.graph.delete_nodes(ids, detach)


def cypher_write(graph: Graph, query: str, params: dict[str, Any] | None = None) -> Graph:
    """The graph after a statement: MATCH clauses, then CREATE, MERGE (ON CREATE SET, ON MATCH SET), SET, REMOVE, DELETE or DETACH DELETE.

    Without MATCH the writing clauses run once. DELETE of nodes that still have edges raises.
    """
    reads, writes = WriteParser(query).statement()
    w = Writer(graph, params or {})
    compiler = Compiler(graph, params or {}, False)
    df: DataFrame | None = None
    for clause in reads:
        df = compiler.match(df, clause)
    if df is None:
        df = graph.nodes.sparkSession.range(1).select(F.lit(1).alias("__row"))
    for kind, *rest in writes:
        if kind == "create":
            for parts in rest[0]:
                df, _ = w.path(df, parts, merge=False)
        elif kind == "merge":
            df = w.merge(df, *rest)
        elif kind == "set":
            w.set(df, rest[0])
        elif kind == "remove":
            w.remove(df, rest[0])
        else:
            w.delete(df, *rest)
    return w.graph
