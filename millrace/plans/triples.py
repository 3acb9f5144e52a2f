"""Query templates over triples(s, p, o), and a small GraphQL over a property graph."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import Graph


# ---- templates -----------------------------------------------------------------------------------
def entity(t: DataFrame, s: str) -> DataFrame:
    """p, o of a subject."""
    return t.filter(F.col("s") == s).select("p", "o")


def properties(t: DataFrame, s: str, names: list[str]) -> DataFrame:
    """p, o of a subject, of some predicates."""
    return entity(t, s).filter(F.col("p").isin(names))


def direct(t: DataFrame, s: str, p: str) -> DataFrame:
    """o that a subject has by a predicate."""
    return t.filter((F.col("s") == s) & (F.col("p") == p)).select("o")


def inverse(t: DataFrame, o: str, p: str) -> DataFrame:
    """s that have an object by a predicate."""
    return t.filter((F.col("o") == o) & (F.col("p") == p)).select("s")


def of_type(t: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    return inverse(t, kind, "type").orderBy("s").limit(limit)


def path(t: DataFrame, s: str, predicates: list[str]) -> DataFrame:
    """o at the end of a chain of predicates."""
    now = direct(t, s, predicates[0])
    for p in predicates[1:]:
        now = now.join(t.filter(F.col("p") == p).select(F.col("s").alias("o"), F.col("o").alias("next")), "o").select(F.col("next").alias("o"))
    return now.distinct()


def similar(t: DataFrame, s: str, limit: int = 10) -> DataFrame:
    """s, shared: subjects with the most predicate-object pairs in common."""
    own = entity(t, s)
    return t.filter(F.col("s") != s).join(own, ["p", "o"]).groupBy("s").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "s").limit(limit)


def predicate_counts(t: DataFrame) -> DataFrame:
    return t.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


def exists(t: DataFrame, s: str, p: str, o: str) -> bool:
    return not t.filter((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).isEmpty()


# ---- GraphQL --------------------------------------------------------------------------------------
_WORD = re.compile(r'\s+|,|(?P<t>[A-Za-z_]\w*|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|[{}():])')


def _parse(text: str) -> list[tuple[str, dict[str, Any], list]]:
    words, at = [], 0
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        if m["t"]:
            words.append(m["t"])
        at = m.end()
    i = 0

    def take(want: str | None = None) -> str:
        nonlocal i
        if i >= len(words) or (want and words[i] != want):
            raise ValueError(f"expected {want or 'more'}")
        i += 1
        return words[i - 1]

    def block() -> list[tuple[str, dict[str, Any], list]]:
        take("{")
        out = []
        while words[i : i + 1] != ["}"]:
            name, args, inner = take(), {}, []
            if words[i : i + 1] == ["("]:
                take("(")
                while words[i : i + 1] != [")"]:
                    key = take()
                    take(":")
                    v = take()
                    args[key] = v[1:-1] if v[0] == '"' else float(v) if "." in v else int(v) if re.fullmatch(r"-?\d+", v) else v
                take(")")
            if words[i : i + 1] == ["{"]:
                inner = block()
            out.append((name, args, inner))
        take("}")
        return out

    if words[:1] == ["query"]:
        take()
    found = block()
    if i != len(words):
        raise ValueError("text after the query")
    return found


def graphql(graph: Graph, text: str) -> DataFrame:
    """One top field is a label, with property arguments and limit: { Person(city: "LA", limit: 5) { name KNOWS { name } } }.

    A nested field is an edge type, walked forwards; it gives an array of structs. Other fields are properties.
    """
    tops = _parse(text)
    if len(tops) != 1:
        raise ValueError("one top field is wanted")
    label, args, fields = tops[0]
    limit = args.pop("limit", None)
    df = graph.scan(label, **args)
    if limit is not None:
        df = df.orderBy("id").limit(int(limit))
    out = df.select("id", *(f for f, _, inner in fields if not inner and f != "id"))
    for edge, _, inner in fields:
        if not inner:
            continue
        names = [f for f, _, deeper in inner if not deeper]
        hop = graph.edges.filter(F.col("type") == edge).select(F.col("src").alias("id"), "dst")
        ends = graph.nodes.select(F.col("id").alias("dst"), F.struct(*names).alias("x"))
        found = hop.join(ends, "dst").groupBy("id").agg(F.array_sort(F.collect_list("x")).alias(edge))
        out = out.join(found, "id", "left")
    return out if any(f == "id" for f, _, _ in fields) else out.drop("id")
