"""A subset of Cypher, compiled to DataFrames.

Reading clauses: MATCH and OPTIONAL MATCH (chains, comma lists, variable lengths with a bound), WHERE,
UNWIND, WITH, RETURN [DISTINCT] with aggregates, ORDER BY, SKIP, LIMIT, UNION [ALL], CASE, functions, $parameters.
A variable is a struct column. Catalyst prunes its fields and pushes its filters into the scans.

Chosen where others differ: nulls sort last both ways; a RETURN without any MATCH gives no rows; an unknown
function or property is null; UNION goes by position and removes all duplicates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.operators.graph import Graph

_TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<par>\$\w+)|(?P<name>[^\W\d]\w*|`[^`]*`)|(?P<op><>|!=|<=|>=|\.\.|=~|[-+*/%^=<>()\[\]{},.:|])""")


class CypherError(ValueError):
    """The text isn't in the subset."""


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int


def tokenise(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return [*out, Token("end", "", at, at)]


@dataclass
class NodePattern:
    name: str
    labels: list[str]
    properties: dict[str, Any]


@dataclass
class RelPattern:
    name: str | None
    types: list[str]
    direction: str
    low: int = 1
    high: int = 1


@dataclass
class Item:
    expr: Any
    name: str


@dataclass
class Projection:
    items: list[Item]
    distinct: bool = False
    star: bool = False
    order: list[tuple[Any, bool, str]] = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    where: Any = None


class Parser:
    """Recursive descent; expressions are tuples (kind, ...)."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.i, self.fresh = text, tokenise(text), 0, 0

    # ---- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def word(self, *words: str) -> bool:
        """Takes the keywords if they all follow."""
        for k, w in enumerate(words):
            t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if t.kind != "name" or t.text.upper() != w:
                return False
        self.i += len(words)
        return True

    def sign(self, s: str) -> bool:
        if self.now.kind == "op" and self.now.text == s:
            self.i += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            raise CypherError(f"expected {s!r} at {self.now.at}, found {self.now.text!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise CypherError(f"expected a name at {self.now.at}, found {self.now.text!r}")
        self.i += 1
        return self.tokens[self.i - 1].text.strip("`")

    # ---- query
    def query(self) -> list[tuple[bool, list]]:
        arms = [(False, self.single())]
        while self.word("UNION"):
            arms.append((self.word("ALL"), self.single()))
        if self.now.kind != "end":
            raise CypherError(f"unexpected {self.now.text!r} at {self.now.at}")
        return arms

    def single(self) -> list:
        clauses: list = []
        while True:
            if self.word("OPTIONAL", "MATCH"):
                clauses.append(("match", True, self.patterns(), self.where()))
            elif self.word("MATCH"):
                clauses.append(("match", False, self.patterns(), self.where()))
            elif self.word("UNWIND"):
                e = self.expr()
                if not self.word("AS"):
                    raise CypherError("UNWIND needs AS")
                clauses.append(("unwind", e, self.name()))
            elif self.word("WITH"):
                p = self.projection()
                p.where = self.where()
                clauses.append(("with", p))
            elif self.word("RETURN"):
                clauses.append(("return", self.projection()))
                return clauses
            else:
                raise CypherError(f"expected a clause at {self.now.at}, found {self.now.text!r}")

    def where(self) -> Any:
        return self.expr() if self.word("WHERE") else None

    def patterns(self) -> list[list]:
        out = [self.path()]
        while self.sign(","):
            out.append(self.path())
        return out

    def path(self) -> list:
        out: list = [self.node()]
        while self.now.kind == "op" and self.now.text in ("-", "<"):
            out += [self.rel(), self.node()]
        return out

    def node(self) -> NodePattern:
        self.need("(")
        name = self.name() if self.now.kind == "name" else None
        if name is None:
            self.fresh += 1
            name = f"__n{self.fresh}"
        labels = []
        while self.sign(":"):
            labels.append(self.name())
        props = self.map() if self.now.text == "{" else {}
        self.need(")")
        return NodePattern(name, labels, props)

    def map(self) -> dict[str, Any]:
        self.need("{")
        out = {}
        while not self.sign("}"):
            k = self.name()
            self.need(":")
            out[k] = self.expr()
            self.sign(",")
        return out

    def rel(self) -> RelPattern:
        back = self.sign("<")
        self.need("-")
        name, types, low, high = None, [], 1, 1
        if self.sign("["):
            if self.now.kind == "name":
                name = self.name()
            if self.sign(":"):
                types.append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    types.append(self.name())
            if self.sign("*"):
                low, high = 1, -1
                if self.now.kind == "num":
                    low = high = int(self.now.text)
                    self.i += 1
                if self.sign(".."):
                    high = -1
                    if self.now.kind == "num":
                        high = int(self.now.text)
                        self.i += 1
                if high < low:
                    raise CypherError("a variable length needs an upper bound")
            self.need("]")
        self.need("-")
        on = self.sign(">")
        return RelPattern(name, types, "in" if back and not on else "out" if on and not back else "both", low, high)

    def projection(self) -> Projection:
        p = Projection([], self.word("DISTINCT"))
        if self.sign("*"):
            p.star = True
        else:
            p.items.append(self.item())
            while self.sign(","):
                p.items.append(self.item())
        if self.word("ORDER", "BY"):
            while True:
                a = self.now.at
                e = self.expr()
                source = self.text[a : self.tokens[self.i - 1].end]
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                p.order.append((e, down, source))
                if not self.sign(","):
                    break
        if self.word("SKIP"):
            p.skip = self.expr()
        if self.word("LIMIT"):
            p.limit = self.expr()
        return p

    def item(self) -> Item:
        a = self.now.at
        e = self.expr()
        source = self.text[a : self.tokens[self.i - 1].end]
        return Item(e, self.name() if self.word("AS") else source)

    # ---- expressions, loosest first
    def expr(self) -> Any:
        left = self.xor()
        while self.word("OR"):
            left = ("or", left, self.xor())
        return left

    def xor(self) -> Any:
        left = self.both()
        while self.word("XOR"):
            left = ("xor", left, self.both())
        return left

    def both(self) -> Any:
        left = self.not_()
        while self.word("AND"):
            left = ("and", left, self.not_())
        return left

    def not_(self) -> Any:
        return ("not", self.not_()) if self.word("NOT") else self.compare()

    def compare(self) -> Any:
        left = self.sum()
        while True:
            if self.now.kind == "op" and self.now.text in ("=", "<>", "!=", "<", ">", "<=", ">=", "=~"):
                op = self.now.text
                self.i += 1
                left = ("cmp", op, left, self.sum())
            elif self.word("CONTAINS"):
                left = ("call", "contains", [left, self.sum()], False)
            elif self.word("STARTS", "WITH"):
                left = ("call", "starts_with", [left, self.sum()], False)
            elif self.word("ENDS", "WITH"):
                left = ("call", "ends_with", [left, self.sum()], False)
            elif self.word("IN"):
                left = ("in", left, self.sum())
            elif self.word("IS", "NOT", "NULL"):
                left = ("not", ("null", left))
            elif self.word("IS", "NULL"):
                left = ("null", left)
            else:
                return left

    def sum(self) -> Any:
        left = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-"):
            op = self.now.text
            self.i += 1
            left = ("num", op, left, self.product())
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in ("*", "/", "%", "^"):
            op = self.now.text
            self.i += 1
            left = ("num", op, left, self.unary())
        return left

    def unary(self) -> Any:
        if self.sign("-"):
            return ("neg", self.unary())
        e = self.atom()
        while True:
            if self.sign("."):
                e = ("prop", e, self.name())
            elif self.sign("["):
                e = ("index", e, self.expr())
                self.need("]")
            else:
                return e

    def atom(self) -> Any:
        t = self.now
        if t.kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t.text[1:-1]))
        if t.kind == "num":
            self.i += 1
            return ("lit", float(t.text) if "." in t.text else int(t.text))
        if t.kind == "par":
            self.i += 1
            return ("param", t.text[1:])
        if self.sign("("):
            e = self.expr()
            self.need(")")
            return e
        if self.sign("["):
            items = []
            while not self.sign("]"):
                items.append(self.expr())
                self.sign(",")
            return ("list", items)
        if t.kind == "name":
            upper = t.text.upper()
            if upper in ("TRUE", "FALSE", "NULL") and self.tokens[self.i + 1].text != "(":
                self.i += 1
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[upper])
            if self.word("CASE"):
                return self.case()
            n = self.name()
            if self.sign("("):
                if self.sign("*"):
                    self.need(")")
                    return ("call", n, [("lit", 1)], False)
                distinct = self.word("DISTINCT")
                args = []
                while not self.sign(")"):
                    args.append(self.expr())
                    self.sign(",")
                return ("call", n, args, distinct)
            return ("var", n)
        raise CypherError(f"unexpected {t.text!r} at {t.at}")

    def case(self) -> Any:
        subject = None if self.now.text.upper() == "WHEN" else self.expr()
        arms = []
        while self.word("WHEN"):
            c = self.expr()
            if not self.word("THEN"):
                raise CypherError("WHEN needs THEN")
            arms.append((("cmp", "=", subject, c) if subject is not None else c, self.expr()))
        other = self.expr() if self.word("ELSE") else ("lit", None)
        if not self.word("END"):
            raise CypherError("CASE needs END")
        return ("case", arms, other)


def _aggregates(e: Any) -> bool:
    if isinstance(e, tuple):
        return (e[0] == "call" and e[1].lower() in registry.AGGREGATES) or any(_aggregates(x) for x in e[1:])
    return isinstance(e, list) and any(_aggregates(x) for x in e)


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any], strict: bool) -> None:
        self.graph, self.params, self.strict = graph, params, strict

    # ---- expressions
    def col(self, e: Any, df: DataFrame) -> Column:
        kind = e[0]
        c = lambda x: self.col(x, df)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise CypherError(f"no parameter ${e[1]}")
            v = self.params[e[1]]
            return F.array(*(F.lit(x) for x in v)) if isinstance(v, list | tuple) else F.lit(v)
        if kind == "list":
            return F.array(*(c(x) for x in e[1]))
        if kind == "var":
            if e[1] not in df.columns:
                raise CypherError(f"no variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if kind == "prop":
            return self.property(e, df)
        if kind == "index":
            return F.get(c(e[1]), c(e[2]))
        if kind in ("and", "or", "xor"):
            a, b = c(e[1]), c(e[2])
            return a & b if kind == "and" else a | b if kind == "or" else a != b
        if kind == "not":
            return ~c(e[1])
        if kind == "null":
            return c(e[1]).isNull()
        if kind == "neg":
            return -c(e[1])
        if kind == "in":
            return F.array_contains(c(e[2]), c(e[1]))
        if kind == "cmp":
            a, b = c(e[2]), c(e[3])
            return {"=": lambda: a == b, "<>": lambda: a != b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$")))}[e[1]]()
        if kind == "num":
            a, b = c(e[2]), c(e[3])
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: a % b, "^": lambda: F.pow(a, b)}[e[1]]()
        if kind == "case":
            out = None
            for when, then in e[1]:
                out = F.when(c(when), c(then)) if out is None else out.when(c(when), c(then))
            return out.otherwise(c(e[2]))
        return self.call(e, df)

    def property(self, e: Any, df: DataFrame) -> Column:
        base = self.col(e[1], df)
        if e[1][0] == "var":
            kind = df.schema[e[1][1]].dataType
            if e[2] not in getattr(kind, "names", [e[2]]):
                return F.lit(None)
        return base.getField(e[2])

    def call(self, e: Any, df: DataFrame) -> Column:
        _, name, args, distinct = e
        low = name.lower()
        if low in ("id", "type", "labels", "properties", "startnode", "endnode") and len(args) == 1 and args[0][0] == "var":
            v = args[0][1]
            names = getattr(df.schema[v].dataType, "names", []) if v in df.columns else []
            has = {"id": "id", "type": "type", "labels": "labels", "startnode": "src", "endnode": "dst"}.get(low)
            if low == "properties":
                own = [n for n in names if n not in ("id", "labels", "src", "dst", "type")]
                return F.struct(*(F.col(f"`{v}`").getField(n).alias(n) for n in own)) if own else F.lit(None)
            if low == "labels" and "labels" not in names:
                return F.array().cast("array<string>")
            return F.col(f"`{v}`").getField(has) if has in names else F.lit(None)
        if low == "keys" and args and args[0][0] == "var" and (names := getattr(df.schema[args[0][1]].dataType, "names", None)):
            v = F.col(f"`{args[0][1]}`")
            return F.array_compact(F.array(*(F.when(v.getField(n).isNotNull(), F.lit(n)) for n in names if n not in ("id", "labels", "src", "dst", "type"))))
        cols = [self.col(a, df) for a in args]
        if low == "count":
            return F.count_distinct(cols[0]) if distinct else F.count(cols[0])
        if low == "collect" and distinct:
            return F.collect_set(cols[0])
        if distinct and low in ("sum", "avg"):
            return F.sum_distinct(cols[0]) if low == "sum" else F.expr("null")
        if low == "size" and args[0][0] in ("lit", "prop") and not isinstance(args[0][1], list):
            kind = df.select(cols[0].alias("x")).schema["x"].dataType.simpleString()
            return registry.size(cols[0], "string" if kind == "string" else "array")
        return registry.call(name, *cols, strict=self.strict)

    # ---- clauses
    def node(self, p: NodePattern) -> DataFrame:
        df = self.graph.nodes
        for label in p.labels:
            df = df.filter(F.array_contains("labels", label))
        for k, v in p.properties.items():
            df = df.filter(F.col(k) == self.col(v, df)) if k in df.columns else df.limit(0)
        return df.select(F.struct("*").alias(p.name))

    def hops(self, p: RelPattern) -> DataFrame:
        """__a, __b, __r, __u: the ends as walked, the edge (of the last hop), and all edges walked, none of them twice."""
        e = self.graph.edges
        if p.types:
            e = e.filter(F.col("type").isin(p.types))
        one, key = F.struct(*e.columns).alias("__r"), F.array(F.struct("src", "dst", "type")).alias("__u")
        out, back = e.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), one, key), e.select(F.col("dst").alias("__a"), F.col("src").alias("__b"), one, key)
        step = {"out": out, "in": back, "both": out.union(back.filter("__a != __b"))}[p.direction]
        if (p.low, p.high) == (1, 1):
            return step
        now, found = step, None
        for n in range(1, p.high + 1):
            if n > 1:
                more = step.select(F.col("__a").alias("__m"), F.col("__b").alias("__c"), F.col("__r").alias("__s"), F.col("__u").alias("__v"))
                now = now.join(more, F.col("__b") == F.col("__m")).filter(~F.arrays_overlap("__u", "__v"))
                now = now.select("__a", F.col("__c").alias("__b"), F.col("__s").alias("__r"), F.concat("__u", "__v").alias("__u"))
            if n >= p.low:
                found = now if found is None else found.union(now)
        return found

    def path(self, parts: list) -> tuple[DataFrame, list[str]]:
        df, rels = self.node(parts[0]), []
        for rel, node in zip(parts[1::2], parts[2::2], strict=True):
            left = parts[parts.index(rel) - 1].name
            name = rel.name or f"__r_{left}_{node.name}_{len(rels)}"
            df = df.join(self.hops(rel), F.col(f"`{left}`").getField("id") == F.col("__a"))
            if node.name in df.columns:  # the path comes back to a node it has
                df = df.filter(F.col("__b") == F.col(f"`{node.name}`").getField("id"))
            else:
                df = df.join(self.node(node), F.col("__b") == F.col(f"`{node.name}`").getField("id"))
            df = df.drop("__a", "__b").withColumnsRenamed({"__r": name, "__u": f"__u{len(rels)}"})
            for other in range(len(rels)):  # an edge is walked once in a pattern
                df = df.filter(~F.arrays_overlap(f"__u{len(rels)}", f"__u{other}"))
            rels.append(name)
        return df.drop(*(f"__u{i}" for i in range(len(rels)))), rels

    def match(self, df: DataFrame | None, clause: tuple) -> DataFrame:
        _, optional, patterns, where = clause
        for k, parts in enumerate(patterns):
            found, _ = self.path(parts)
            if df is None:
                df = found
                continue
            shared = [c for c in found.columns if c in df.columns]
            renamed = found.withColumnsRenamed({c: f"__x_{c}" for c in shared})
            if shared:
                on = F.lit(True)
                for c in shared:
                    on = on & (F.col(f"`{c}`").getField("id") == F.col(f"`__x_{c}`").getField("id"))
                if optional and where is not None and k == len(patterns) - 1:
                    on = on & self.col(where, df.join(renamed, on))
                df = df.join(renamed, on, "left" if optional else "inner").drop(*(f"__x_{c}" for c in shared))
            else:
                df = df.crossJoin(renamed)  # the language asks for all combinations of unconnected patterns
        return df.filter(self.col(where, df)) if where is not None and not optional else df

    def project(self, df: DataFrame, p: Projection) -> DataFrame:
        items = [Item(("var", c), c) for c in df.columns if not c.startswith("__")] if p.star else p.items
        names = [i.name for i in items]
        hidden: list[tuple[str, Column]] = []
        order: list[Column] = []
        grouped = any(_aggregates(i.expr) for i in items)
        for e, down, source in p.order:
            target = source if source in names else next((i.name for i in items if i.expr == e), None)
            if target is None:
                target = f"__o{len(hidden)}"
                hidden.append((target, self.col(e, df)))
            key = F.col(f"`{target}`")
            order.append(key.desc_nulls_last() if down else key.asc_nulls_last())
        if grouped:
            keys = [self.col(i.expr, df).alias(i.name) for i in items if not _aggregates(i.expr)]
            values = [self.col(i.expr, df).alias(i.name) for i in items if _aggregates(i.expr)] + [c.alias(n) for n, c in hidden]
            out = df.groupBy(*keys).agg(*values).select(*(F.col(f"`{n}`") for n in [*names, *(n for n, _ in hidden)]))
        else:
            out = df.select(*(self.col(i.expr, df).alias(i.name) for i in items), *(c.alias(n) for n, c in hidden))
        if p.distinct:
            out = out.distinct()
        if order:
            out = out.orderBy(*order)
        number = lambda e: int(self.params[e[1]] if e[0] == "param" else e[1])
        if p.skip is not None:
            out = out.offset(number(p.skip))
        if p.limit is not None:
            out = out.limit(number(p.limit))
        return out.drop(*(n for n, _ in hidden))

    def single(self, clauses: list) -> DataFrame:
        df: DataFrame | None = None
        for clause in clauses:
            if clause[0] == "match":
                df = self.match(df, clause)
            elif clause[0] == "unwind":
                base = df if df is not None else self.graph.nodes.sparkSession.range(1).select()
                df = base.withColumn(clause[2], F.explode(self.col(clause[1], base)))
            else:
                p = clause[1]
                out = self.project(df if df is not None else self.graph.nodes.limit(0), p)
                df = out.filter(self.col(p.where, out)) if p.where is not None else out
        return df


def cypher(graph: Graph, query: str, params: dict[str, Any] | None = None, strict: bool = False) -> DataFrame:
    """The query's result. Columns without an alias are named as they are written."""
    if not query or not query.strip():
        raise CypherError("an empty query")
    arms = Parser(query).query()
    compiler = Compiler(graph, params or {}, strict)
    out = compiler.single(arms[0][1])
    for all_, clauses in arms[1:]:
        nxt = compiler.single(clauses)
        if len(nxt.columns) != len(out.columns):
            raise CypherError("the arms of UNION differ in their number of columns")
        out = out.union(nxt)
        if not all_:
            out = out.distinct()
    return out
