"""Property graphs as two DataFrames, and what is computed on them.

nodes: id, labels (array of string), then property columns. edges: src, dst, type, then property
columns. Loops over hops write each frontier to the shared folder; they stop on an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.shared import write_table


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # ---- scans ---------------------------------------------------------------------------------
    def scan(self, label: str | None = None, **properties) -> DataFrame:
        """Nodes with a label and with properties equal to values."""
        out = self.nodes if label is None else self.nodes.filter(F.array_contains("labels", label))
        for k, v in properties.items():
            out = out.filter(F.col(k) == F.lit(v))
        return out

    def seeds(self, ids: list[str]) -> DataFrame:
        """Those of the ids that are nodes."""
        return self.nodes.filter(F.col("id").isin(list(ids)))

    def headers(self, ids: DataFrame) -> DataFrame:
        """Nodes of ids(id); missing ids are left out."""
        return self.nodes.join(ids.select("id").distinct(), "id")

    # ---- hops -----------------------------------------------------------------------------------
    def directed(self, types: list[str] | None = None, direction: str = "out") -> DataFrame:
        """src, dst, type as seen by who walks out, in or both ways."""
        e = self.edges.select("src", "dst", "type")
        if types:
            e = e.filter(F.col("type").isin(list(types)))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
        return {"out": e, "in": back, "both": e.union(back)}[direction]

    def expand(self, ids: DataFrame, types: list[str] | None = None, direction: str = "out", max_per_node: int | None = None) -> DataFrame:
        """src, dst, type of a hop from ids(id); a node's edges are capped in order of (dst, type)."""
        e = self.directed(types, direction).join(ids.select(F.col("id").alias("src")).distinct(), "src")
        if max_per_node is not None:
            e = e.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy("dst", "type"))).filter(F.col("rn") <= max_per_node).drop("rn")
        return e

    def traverse(self, ids: DataFrame, max_depth: int, types: list[str] | None = None, direction: str = "out", max_nodes: int | None = None, whole: bool = False) -> DataFrame:
        """id, depth: least number of hops from ids(id), which have 0 themselves.

        ``max_nodes`` keeps the nearest, and of equally near ones those with the least id. With ``whole``, nodes
        that may lie beyond ``max_depth`` raise. The edges are written once, in order of where they start.
        """
        edges = self.directed(types, direction).select("src", "dst").distinct()
        if max_depth > 1:
            edges = write_table(edges, "traverse-edges")
        seen = write_table(ids.select("id").distinct().withColumn("depth", F.lit(0)), "traverse")
        front = seen
        for depth in range(1, max_depth + 1):
            found = front.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
            front = write_table(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "traverse")
            if front.isEmpty():
                break
            seen = seen.union(front)
            if max_nodes is not None and seen.count() >= max_nodes:
                break
        else:
            if whole and not front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).join(seen, "id", "left_anti").isEmpty():
                raise RuntimeError(f"there are nodes beyond {max_depth} hops")
        return seen if max_nodes is None else seen.orderBy("depth", "id").limit(max_nodes)

    def focus(self, node: str, max_depth: int) -> Graph:
        """Nodes within ``max_depth`` of one, whatever the direction, and all edges among them."""
        near = self.traverse(self.nodes.filter(F.col("id") == node).select("id"), max_depth, direction="both").select("id")
        return Graph(self.nodes.join(near, "id", "left_semi"), self.edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi"))

    def closure(self, ids: DataFrame, types: list[str] | None = None, direction: str = "out", max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
        """What ids reach, as (id, depth), and the edges used, which start before the last depth. Without ``max_depth`` all of it, which raises beyond 64 hops."""
        reached = self.traverse(ids, max_depth or 64, types, direction, whole=max_depth is None)
        used = self.directed(types, direction).join(reached.filter(F.col("depth") < (max_depth or 64)).select(F.col("id").alias("src")), "src")
        return reached, used

    def paths(self, ids: DataFrame, max_depth: int, types: list[str] | None = None, direction: str = "out") -> DataFrame:
        """path: arrays of node ids without repetition, of 1 to ``max_depth`` hops."""
        edges = self.directed(types, direction).select("src", "dst").distinct()
        front = ids.select(F.array("id").alias("path"), F.col("id").alias("src"))
        out = None
        for _ in range(max_depth):
            step = front.join(edges, "src").filter(~F.array_contains("path", F.col("dst")))
            front = write_table(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src")), "paths")
            out = front if out is None else out.union(front)
            if front.isEmpty():
                break
        return out.select("path")

    def impact(self, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
        """direction, id, depth of everything upstream and downstream. Raises beyond 64 hops."""
        down = self.traverse(ids, 64, types, "out", whole=True).filter("depth > 0").withColumn("direction", F.lit("downstream"))
        up = self.traverse(ids, 64, types, "in", whole=True).filter("depth > 0").withColumn("direction", F.lit("upstream"))
        return down.union(up).select("direction", "id", "depth")

    # ---- measures -------------------------------------------------------------------------------
    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree, degree of every node."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        both = self.nodes.select("id").join(sums, "id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return both.select("id", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("degree"))

    def critical(self, threshold: int) -> DataFrame:
        return self.degrees().filter(F.col("degree") >= threshold).select("id", "degree").orderBy(F.desc("degree"), "id")

    def roots(self) -> DataFrame:
        return self.nodes.select("id").join(self.edges.select(F.col("dst").alias("id")), "id", "left_anti")

    def leaves(self) -> DataFrame:
        return self.nodes.select("id").join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def metrics(self) -> DataFrame:
        """One row: counts, average and greatest degree of nodes with an edge, density E / (V (V - 1) / 2), components."""
        v, e = self.nodes.agg(F.count("*").alias("n_nodes")), self.edges.agg(F.count("*").alias("n_edges"))
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
        d = ends.agg(F.coalesce(F.avg("count"), F.lit(0.0)).alias("avg_degree"), F.coalesce(F.max("count"), F.lit(0)).alias("max_degree"))
        parts = self.components().agg(F.countDistinct("component").alias("n_components"))
        out = v.crossJoin(e).crossJoin(d).crossJoin(parts)  # four tables of one row each
        pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
        return out.withColumn("density", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0))

    def components(self) -> DataFrame:
        """id, component of every node; a node without edges is its own."""
        linked = connected_components(self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        return self.nodes.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def communities(self) -> DataFrame:
        """component, size, n_edges (parallel ones and loops count), density (0 below two nodes), cohesion = density * size."""
        of = self.components()
        size = of.groupBy("component").agg(F.count("*").alias("size"))
        inside = self.edges.join(of.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
        pairs = F.col("size") * (F.col("size") - 1) / 2
        out = size.join(inside, "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
        out = out.withColumn("density", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0))
        return out.withColumn("cohesion", F.col("density") * F.col("size"))

    def dangling(self) -> DataFrame:
        """Edges of which an end is no node."""
        ids = self.nodes.select("id").distinct()
        lost = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(self.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        return lost.distinct()

    # ---- derived edges ---------------------------------------------------------------------------
    def suggest(self, min_score: float = 0.3, limit: int = 20, max_degree: int | None = None) -> DataFrame:
        """src, dst, score: missing edges of two nodes with common neighbours, by Jaccard of neighbours.

        All neighbours are witnesses; with ``max_degree``, those with more edges aren't, which changes scores but spares the pairs around hubs.
        """
        both = self.directed(direction="both").select("src", "dst").distinct()
        degree = both.groupBy("src").agg(F.count("*").alias("d"))
        witness = both if max_degree is None else both.join(degree.filter(F.col("d") <= max_degree).select(F.col("src").alias("dst")), "dst", "left_semi")
        a, b = witness.alias("a"), witness.alias("b")
        common = a.join(b, (F.col("a.dst") == F.col("b.dst")) & (F.col("a.src") < F.col("b.src"))).groupBy(F.col("a.src").alias("x"), F.col("b.src").alias("y")).agg(F.count("*").alias("common"))
        new = common.join(both.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"], "left_anti")
        scored = new.join(degree.select(F.col("src").alias("x"), F.col("d").alias("dx")), "x").join(degree.select(F.col("src").alias("y"), F.col("d").alias("dy")), "y")
        score = F.col("common") / (F.col("dx") + F.col("dy") - F.col("common"))
        return scored.select(F.col("x").alias("src"), F.col("y").alias("dst"), score.alias("score")).filter(F.col("score") >= min_score).orderBy(F.desc("score"), "src", "dst").limit(limit)

    def propagate(self, vectors: DataFrame, hops: int = 1) -> DataFrame:
        """vectors(id, vec) after ``hops`` rounds of averaging a node's vector with its neighbours' mean."""
        both = self.directed(direction="both").select("src", "dst").distinct()
        now = vectors.select("id", "vec")
        for _ in range(hops):
            part = both.join(now.select(F.col("id").alias("dst"), "vec"), "dst").select("src", F.posexplode("vec").alias("i", "v"))
            mean = part.groupBy("src", "i").agg(F.avg("v").alias("v")).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
            joined = now.join(mean.withColumnRenamed("src", "id"), "id", "left")
            mixed = F.zip_with("vec", F.col("m")["v"], lambda a, b: (a + b) / 2)
            now = write_table(joined.select("id", F.when(F.col("m").isNull(), F.transform("vec", lambda x: x.cast("double"))).otherwise(mixed).alias("vec")), "propagate")
        return now

    def materialise(self, subclass: str = "subClassOf", subproperty: str = "subPropertyOf", transitive: tuple[str, ...] = (), symmetric: tuple[str, ...] = (), inverse: dict[str, str] | None = None, max_rounds: int = 20) -> DataFrame:
        """src, dst, type with what an ontology implies, to a fixpoint: "type" edges climb ``subclass``, edges take on their property's ``subproperty``."""
        now = write_table(self.edges.select("src", "dst", "type").distinct(), "ontology")
        up = {subclass, subproperty, *transitive}
        for _ in range(max_rounds):
            n = now.count()
            a, b = now.alias("a"), now.alias("b")
            parts = [now, a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("a.type") == F.col("b.type")) & F.col("a.type").isin(list(up))).select("a.src", "b.dst", "a.type")]
            parts.append(a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("a.type") == "type") & (F.col("b.type") == subclass)).select("a.src", "b.dst", "a.type"))
            parts.append(a.join(b, (F.col("a.type") == F.col("b.src")) & (F.col("b.type") == subproperty)).select("a.src", "a.dst", F.col("b.dst").alias("type")))
            if symmetric:
                parts.append(now.filter(F.col("type").isin(list(symmetric))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
            for p, q in (inverse or {}).items():
                for x, y in ((p, q), (q, p)):
                    parts.append(now.filter(F.col("type") == x).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(y).alias("type")))
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            now = write_table(out.distinct(), "ontology")
            if now.count() == n:
                return now
        raise RuntimeError(f"the ontology did not settle in {max_rounds} rounds")

    # ---- changes: each gives a new graph ----------------------------------------------------------
    def add_nodes(self, new: DataFrame) -> Graph:
        """Nodes of ``new`` replace those with the same id."""
        kept = self.nodes.join(new.select("id"), "id", "left_anti")
        return Graph(kept.unionByName(new, allowMissingColumns=True), self.edges)

    def add_edges(self, new: DataFrame) -> Graph:
        kept = self.edges.join(new.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
        return Graph(self.nodes, kept.unionByName(new, allowMissingColumns=True))

    def merge_nodes(self, new: DataFrame, on_match: dict[str, Column] | None = None) -> Graph:
        """New ids are added; matched nodes get the columns of ``on_match``."""
        nodes = self.nodes
        if on_match:
            hit = nodes.join(new.select("id").distinct(), "id", "left_semi").withColumns(on_match)
            nodes = nodes.join(new.select("id"), "id", "left_anti").unionByName(hit)
        fresh = new.join(self.nodes.select("id"), "id", "left_anti")
        return Graph(nodes.unionByName(fresh, allowMissingColumns=True), self.edges)

    def delete_nodes(self, ids: DataFrame, detach: bool = False) -> Graph:
        """Without ``detach``, nodes that still have edges raise."""
        gone = ids.select("id").distinct()
        touched = self.edges.join(gone, (F.col("id") == F.col("src")) | (F.col("id") == F.col("dst")), "left_semi") if not detach else None
        if touched is not None and not touched.isEmpty():
            raise ValueError("the nodes still have edges; delete them with detach")
        rest = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), rest.select(self.edges.columns))

    def set_property(self, condition: Column, **values: Column) -> Graph:
        return Graph(self.nodes.withColumns({k: F.when(condition, v).otherwise(F.col(k) if k in self.nodes.columns else F.lit(None)) for k, v in values.items()}), self.edges)

    def remove_property(self, condition: Column, name: str) -> Graph:
        return Graph(self.nodes.withColumn(name, F.when(~F.coalesce(condition, F.lit(False)), F.col(name))), self.edges)

    def remove_label(self, condition: Column, label: str) -> Graph:
        return Graph(self.nodes.withColumn("labels", F.when(condition, F.array_remove("labels", label)).otherwise(F.col("labels"))), self.edges)


def verify(source: Graph, target: Graph, columns: list[str]) -> DataFrame:
    """id, state of nodes that differ: missing, extra or changed (nulls are equal)."""
    a, b = source.nodes.select("id", *columns).alias("a"), target.nodes.select("id", *columns).alias("b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    state = F.when(F.col("b.id").isNull(), "missing").when(F.col("a.id").isNull(), "extra").when(~same, "changed")
    return out.select(F.coalesce("a.id", "b.id").alias("id"), state.alias("state")).filter("state is not null")


def label_difference(source: Graph, target: Graph) -> DataFrame:
    """kind, name, side of labels and edge types that only one of the graphs has."""
    def names(g: Graph) -> DataFrame:
        return g.nodes.select(F.lit("label").alias("kind"), F.explode("labels").alias("name")).union(g.edges.select(F.lit("type"), "type")).distinct()

    return names(source).subtract(names(target)).withColumn("side", F.lit("source")).union(names(target).subtract(names(source)).withColumn("side", F.lit("target")))


def cooccurrence(mentions: DataFrame, group: str, item: str) -> DataFrame:
    """a < b, strength: number of groups that have both items."""
    m = mentions.select(group, item).distinct()
    pairs = m.alias("x").join(m.alias("y"), (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{item}") < F.col(f"y.{item}")))
    return pairs.groupBy(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b")).agg(F.count("*").alias("strength"))


def resolve_entities(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """entities(id, name) -> id, canonical: names whose edit similarity 1 - distance / length of the longer reaches the threshold, transitively.

    Two names within k edits share one of k + 1 pieces of the longer, moved by k places at most. So the longer posts its pieces, the
    shorter looks up what could be one of them, for each length that it could be matched with, and the distance decides.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold lies between 0.5 and 1")
    edits = f"cast(floor({1 - threshold!r} * n + 1e-9) as int)"
    piece = f"struct(n, i, cast(floor(i * n / ({edits} + 1)) as int) as at, cast(floor((i + 1) * n / ({edits} + 1)) as int) - cast(floor(i * n / ({edits} + 1)) as int) as size)"
    pieces = f"transform(sequence(0, {edits}), i -> {piece})"
    own = entities.select("id", F.lower(F.trim("name")).alias("name")).filter("length(name) > 0").withColumn("n", F.length("name"))
    posted = own.withColumn("p", F.explode(F.expr(pieces))).selectExpr("id", "name", "n", "p.i as i", "substring(name, p.at + 1, p.size) as piece")
    lengths = f"sequence(length(name), cast(floor(length(name) / {threshold!r} + 1e-9) as int))"
    probes = own.drop("n").withColumn("n", F.explode(F.expr(lengths))).withColumn("p", F.explode(F.expr(pieces))).withColumn("k", F.expr(edits))
    probes = probes.withColumn("lo", F.expr("greatest(0, p.at - k)")).withColumn("hi", F.expr("least(length(name) - p.size, p.at + k)")).filter("hi >= lo")
    probes = probes.selectExpr("id as own", "name as mine", "n", "p.i as i", "explode(array_distinct(transform(sequence(lo, hi), s -> substring(name, s + 1, p.size)))) as piece")
    met = probes.join(posted, ["n", "i", "piece"]).filter("own != id").select("own", "mine", "id", "name").distinct()
    pairs = met.filter(1 - F.levenshtein("mine", "name") / F.greatest(F.length("mine"), F.length("name")) >= threshold - 1e-9)
    groups = connected_components(pairs.select(F.col("own").alias("u"), F.col("id").alias("v")))
    return entities.select("id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("canonical"))


def beam(graph: Graph, ids: DataFrame, vectors: DataFrame, query: list[float], width: int = 5, hops: int = 2) -> DataFrame:
    """id, hop, score: of each hop's new nodes the ``width`` closest to the query by cosine."""
    from millrace.operators.retrieval import cosine

    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("id", cosine(F.col("vec"), q).alias("score"))
    seen = write_table(ids.select("id").join(scored, "id").withColumn("hop", F.lit(0)).select("id", "hop", "score"), "beam")
    front = seen
    for hop in range(1, hops + 1):
        step = graph.expand(front, direction="both").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").join(scored, "id")
        front = write_table(step.orderBy(F.desc("score"), "id").limit(width).select("id", F.lit(hop).alias("hop"), "score"), "beam")
        seen = seen.union(front)
    return seen


def from_star_schema(spark: SparkSession, sf_dir: str) -> Graph:
    """The order tables as a graph: Customer, Order, Part, Supplier, Nation, Region with ids "<Label>:<key>"."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    spec = (("Customer", "customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"}), ("Order", "orders", "o_orderkey", {"totalprice": "o_totalprice", "status": "o_orderstatus", "priority": "o_orderpriority"}), ("Part", "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "size": "p_size"}), ("Supplier", "supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}), ("Nation", "nation", "n_nationkey", {"name": "n_name"}), ("Region", "region", "r_regionkey", {"name": "r_name"}))
    nodes = None
    for label, table, key, props in spec:
        part = t(table).select(F.concat(F.lit(f"{label}:"), F.col(key)).alias("id"), F.array(F.lit(label)).alias("labels"), *(F.col(c).alias(p) for p, c in props.items()))
        nodes = part if nodes is None else nodes.unionByName(part, allowMissingColumns=True)

    def edge(df: DataFrame, kind: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{a}:"), F.col(ka)).alias("src"), F.concat(F.lit(f"{b}:"), F.col(kb)).alias("dst"), F.lit(kind).alias("type"))

    line = t("lineitem")
    edges = edge(t("orders"), "PLACED", "Customer", "o_custkey", "Order", "o_orderkey")
    edges = edges.union(edge(line, "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey")).union(edge(line.select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", "Part", "l_partkey", "Supplier", "l_suppkey"))
    edges = edges.union(edge(t("customer"), "LIVES_IN", "Customer", "c_custkey", "Nation", "c_nationkey")).union(edge(t("supplier"), "BASED_IN", "Supplier", "s_suppkey", "Nation", "s_nationkey"))
    return Graph(nodes, edges.union(edge(t("nation"), "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey")))
