"""The registered queries over the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry as R
from millrace.functions import text as T
from millrace.operators import etl, quality, retrieval, stats
from millrace.operators.graph import Graph, cooccurrence, from_star_schema, label_difference, verify
from millrace.plans import ir, pipeline
from millrace.plans.cypher import cypher
from millrace.sources import io
from millrace.streaming import metrics

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from millrace.plans import catalog_more  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.load(spark, f"{d}/{name}.parquet", "parquet")


_graphs: dict[tuple[str, str], Graph] = {}


def g(spark: SparkSession, d: str) -> Graph:
    """The order tables' graph; its plan is made once for an application and folder, the data is never cached."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _graphs:
        _graphs[key] = from_star_schema(spark, d)
    return _graphs[key]


# ---- graph queries -------------------------------------------------------------------------------
@query("select c_name as name, count(*) as n from customer join orders on o_custkey = c_custkey where o_totalprice > 100000 group by c_name order by n desc, name limit 10")
def cypher_match_agg_topk(spark, d):
    return cypher(g(spark, d), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name AS name, COUNT(o) AS n ORDER BY n DESC, name LIMIT 10")


@query("select n_name as name from nation where n_regionkey < 2 union select n_name from nation where n_regionkey > 0")
def cypher_union(spark, d):
    return cypher(g(spark, d), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.id IN ['Region:0', 'Region:1'] RETURN n.name AS name UNION MATCH (m:Nation)-[:IN_REGION]->(r:Region) WHERE r.id <> 'Region:0' RETURN m.name")


@query("select n_name as name from nation where n_regionkey < 2 union all select n_name from nation where n_regionkey > 0")
def cypher_union_all(spark, d):
    return cypher(g(spark, d), "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.id IN ['Region:0', 'Region:1'] RETURN n.name AS name UNION ALL MATCH (m:Nation)-[:IN_REGION]->(r:Region) WHERE r.id <> 'Region:0' RETURN m.name")


@query("select r_name as region, count(*) as customers, round(avg(c_acctbal), 4) as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name")
def cypher_two_hops(spark, d):
    out = cypher(g(spark, d), "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS customers, avg(c.acctbal) AS balance")
    return out.withColumn("balance", F.round("balance", 4))


@query("select case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, count(*) as n from customer where c_name like 'Customer%' group by 1")
def cypher_case_functions(spark, d):
    return cypher(g(spark, d), "MATCH (c:Customer) WHERE c.name STARTS WITH 'Customer' RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(c) AS n")


@query("select n_name as nation, count(s_suppkey) as suppliers from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name")
def cypher_optional_match(spark, d):
    return cypher(g(spark, d), "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:BASED_IN]->(n) WHERE s.acctbal > 5000 RETURN n.name AS nation, count(s) AS suppliers")


@query("select c_name as name, c_acctbal as balance from customer order by c_acctbal, c_name limit 10 offset 20")
def cypher_skip_limit(spark, d):
    return cypher(g(spark, d), "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS balance ORDER BY c.acctbal, c.name SKIP 20 LIMIT 10")


@query("select distinct p_brand as brand from part where p_size in (1, 2, 3) and p_name is not null")
def cypher_distinct_in(spark, d):
    return cypher(g(spark, d), "MATCH (p:Part) WHERE p.size IN $sizes AND p.name IS NOT NULL RETURN DISTINCT p.brand AS brand", {"sizes": [1, 2, 3]})


@query("with e as (select 'Order:' || l_orderkey as src, 'Part:' || l_partkey as dst, row_number() over (partition by l_orderkey order by 'Part:' || l_partkey) as rn from lineitem) select distinct dst as id, 'Part' as type, p_name as name from e join part on dst = 'Part:' || p_partkey where rn <= 2")
def ir_expand_degree_cap(spark, d):
    return ir.execute(g(spark, d), ir.QueryIR.from_ops([ir.ScanType("Order"), ir.Expand(("CONTAINS",), "out", 2), ir.Project(("id", "type", "name"))]))


@query("select 'Customer:' || c_custkey as id, 'Customer' as type, c_name as name from customer order by id limit 25")
def ir_scan_limit(spark, d):
    return ir.execute(g(spark, d), ir.QueryIR.from_ops([ir.ScanType("Customer"), ir.Limit(25), ir.Project()]))


_EDGES = """e as (select 'Customer:' || o_custkey as src, 'Order:' || o_orderkey as dst from orders union select 'Order:' || l_orderkey, 'Part:' || l_partkey from lineitem union select 'Part:' || l_partkey, 'Supplier:' || l_suppkey from lineitem
 union select 'Customer:' || c_custkey, 'Nation:' || c_nationkey from customer union select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey from supplier union select 'Nation:' || n_nationkey, 'Region:' || n_regionkey from nation)"""


@query(f"with {_EDGES}, h0 as (select 'Customer:1' as id), h1 as (select distinct dst as id from h0 join e on src = id), h2 as (select distinct dst as id from h1 join e on src = id), h3 as (select distinct dst as id from h2 join e on src = id) select id, min(depth) as depth from (select id, 0 as depth from h0 union all select id, 1 from h1 union all select id, 2 from h2 union all select id, 3 from h3) group by id")
def traverse_depths(spark, d):
    graph = g(spark, d)
    return graph.traverse(graph.seeds(["Customer:1"]), 3)


@query(f"with recursive {_EDGES}, up(id, depth) as (select 'Region:1', 0 union select src, depth + 1 from up join e on dst = id where depth < 2) select id, min(depth) as depth from up group by id")
def closure_reverse(spark, d):
    graph = g(spark, d)
    return graph.closure(graph.seeds(["Region:1"]), direction="in", max_depth=2)[0]


@query(f"with recursive {_EDGES}, p(path, here, n) as (select ['Nation:3'], 'Nation:3', 0 union all select list_append(path, src), src, n + 1 from p join e on dst = here where n < 2 and not list_contains(path, src)) select array_to_string(path, '>') as path from p where n > 0")
def find_paths(spark, d):
    graph = g(spark, d)
    return graph.paths(graph.seeds(["Nation:3"]), 2, direction="in").select(F.array_join("path", ">").alias("path"))


@query(f"with {_EDGES}, deg as (select id, count(*) as c from (select src as id from e union all select dst from e) group by id) select (select count(*) from (select src from e union select dst from e)) as ends, max(c) as max_degree, round(avg(c), 6) as avg_degree from deg")
def graph_degrees(spark, d):
    return g(spark, d).edges.distinct().select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().agg(F.count("*").alias("ends"), F.max("count").alias("max_degree"), F.round(F.avg("count"), 6).alias("avg_degree"))


#: All nodes, and all edges with their types, as often as the graph has them.
_NODES = "n as (select 'Customer:' || c_custkey as id, 'Customer' as label, c_name as name from customer union all select 'Order:' || o_orderkey, 'Order', null from orders union all select 'Part:' || p_partkey, 'Part', p_name from part union all select 'Supplier:' || s_suppkey, 'Supplier', s_name from supplier union all select 'Nation:' || n_nationkey, 'Nation', n_name from nation union all select 'Region:' || r_regionkey, 'Region', r_name from region)"
_ALL_EDGES = "e as (select 'Customer:' || o_custkey as src, 'Order:' || o_orderkey as dst, 'PLACED' as type from orders union all select 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CONTAINS' from lineitem union all select distinct 'Part:' || l_partkey, 'Supplier:' || l_suppkey, 'SUPPLIED_BY' from lineitem union all select 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'LIVES_IN' from customer union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'BASED_IN' from supplier union all select 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'IN_REGION' from nation)"
#: What the node with the least name in the largest component reaches; all other nodes are components of their own in these tables.
_REACHED = "b as (select src, dst from e union select dst, src from e), s(id) as (select 'Region:0' union select dst from s join b on src = id), least as (select min(id) as least from s)"


@query(f"with recursive {_NODES}, {_ALL_EDGES}, {_REACHED}, deg as (select id, count(*) as c from (select src as id from e union all select dst from e) group by id) select (select count(*) from n) as n_nodes, (select count(*) from e) as n_edges, round(avg(c), 6) as avg_degree, max(c) as max_degree, 1 + (select count(*) from n where id not in (select id from s)) as n_components, round((select count(*) from e) / ((select count(*) from n) * ((select count(*) from n) - 1) / 2), 9) as density from deg")
def graph_metrics(spark, d):
    return g(spark, d).metrics().withColumns({"avg_degree": F.round("avg_degree", 6), "density": F.round("density", 9)})


@query(f"with recursive {_NODES}, {_ALL_EDGES}, {_REACHED} select id, case when id in (select id from s) then least else id end as component from n, least")
def connected_components(spark, d):
    return g(spark, d).components()


@query(f"with {_NODES}, {_ALL_EDGES} select id, (select count(*) from e where dst = id) as in_degree, (select count(*) from e where src = id) as out_degree, (select count(*) from e where dst = id) + (select count(*) from e where src = id) as degree from n")
def lineage_degrees(spark, d):
    return g(spark, d).degrees()


@query(f"with {_NODES}, {_ALL_EDGES} select id, 'leaf' as kind from n where id not in (select src from e) union all select id, 'root' from n where id not in (select dst from e)")
def roots_and_leaves(spark, d):
    graph = g(spark, d)
    return graph.leaves().withColumn("kind", F.lit("leaf")).union(graph.roots().withColumn("kind", F.lit("root")))


@query(f"with {_ALL_EDGES}, deg as (select id, count(*) as degree from (select src as id from e union all select dst from e) group by id) select id, degree from deg where degree >= 5")
def critical_nodes(spark, d):
    return g(spark, d).critical(5)


@query(f"with recursive {_ALL_EDGES}, b as (select distinct src, dst from e), dn(id, depth) as (select 'Supplier:1', 0 union select dst, depth + 1 from dn join b on src = id), up(id, depth) as (select 'Supplier:1', 0 union select src, depth + 1 from up join b on dst = id) select 'downstream' as direction, id, min(depth) as depth from dn where depth > 0 group by id union all select 'upstream', id, min(depth) from up where depth > 0 group by id")
def impact(spark, d):
    graph = g(spark, d)
    return graph.impact(graph.seeds(["Supplier:1"]))


@query("select a.l_partkey as a, b.l_partkey as b, count(distinct a.l_orderkey) as strength from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by 1, 2 having count(distinct a.l_orderkey) > 1")
def cooccurrence_parts(spark, d):
    return cooccurrence(t(spark, d, "lineitem"), "l_orderkey", "l_partkey").filter("strength > 1")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def dangling_edges(spark, d):
    customers = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    orders = t(spark, d, "orders")
    nodes = customers.union(orders.select(F.concat(F.lit("o"), F.col("o_orderkey"))))
    edges = orders.select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("dst"), F.lit("PLACED").alias("type"))
    return Graph(nodes, edges).dangling().select(F.substring("dst", 2, 20).cast("bigint").alias("o_orderkey"))


@query("select 'Nation:' || n_nationkey as id, case when n_nationkey % 5 = 0 then 'missing' else 'changed' end as state from nation where n_nationkey % 5 = 0 or n_nationkey % 7 = 1 union all select 'Part:' || p_partkey, 'missing' from part where p_partkey % 5 = 0")
def graph_verify(spark, d):
    a = g(spark, d)
    label, key = F.split("id", ":")[0], F.split("id", ":")[1].cast("int")
    kept = a.nodes.filter(~label.isin("Nation", "Part") | (key % 5 != 0))
    return verify(a, Graph(kept.withColumn("name", F.when((label == "Nation") & (key % 7 == 1), "x").otherwise(F.col("name"))), a.edges), ["name"])


@query("select 'label' as kind, 'Supplier' as name, 'source' as side union all select 'type', 'BASED_IN', 'source' union all select 'type', 'SUPPLIED_BY', 'source'")
def graph_label_difference(spark, d):
    a = g(spark, d)
    return label_difference(a, a.delete_nodes(a.scan("Supplier").select("id"), detach=True))


@query(f"with {_NODES}, {_ALL_EDGES} select (select count(*) from n where label <> 'Supplier' and id <> 'Region:1') as n_nodes, count(*) as n_edges from e where src not like 'Supplier:%' and dst not like 'Supplier:%' and dst <> 'Region:1'")
def graph_delete(spark, d):
    a = g(spark, d)
    a = a.delete_nodes(a.scan("Supplier").select("id"), detach=True)
    a = a.delete_nodes(a.seeds(["Region:1"]).select("id"), detach=True)
    return a.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(a.edges.agg(F.count("*").alias("n_edges")))


# ---- scans, validation, pipelines -------------------------------------------------------------------
@query("select c_custkey, c_name from customer order by c_custkey limit 10 offset 5")
def page_rows(spark, d):
    return io.page(io.load(spark, f"{d}/customer.parquet", columns=["c_custkey", "c_name", "absent"]), "c_custkey", 5, 10)


@query("select 'o_orderkey' as \"column\", count(*) as n, count(*) - count(o_orderkey) as nulls, min(o_orderkey)::double as min, max(o_orderkey)::double as max, round(avg(o_orderkey), 6) as mean, round(stddev_samp(o_orderkey), 6) as stdev from orders union all select 'o_totalprice', count(*), 0, min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 6), round(stddev_samp(o_totalprice), 6) from orders union all select 'o_orderstatus', count(*), 0, null, null, null, null from orders")
def profile_columns(spark, d):
    out = io.profile(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return out.drop("type").withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("select c_mktsegment as segment, count(*) as n, round(sum(c_acctbal * 2), 4) as doubled from customer where c_acctbal > 0 group by 1")
def pipeline_steps(spark, d):
    steps = [{"type": "filter", "condition": "c_acctbal > 0"}, {"type": "map", "column": "x", "expression": "c_acctbal * 2"}, {"type": "rename", "columns": {"c_mktsegment": "segment"}}, {"type": "aggregate", "by": ["segment"], "values": {"n": "count(*)", "doubled": "round(sum(x), 4)"}}]
    return pipeline.process(t(spark, d, "customer"), steps)


@query("select s_suppkey, round((s_acctbal - lo) / (hi - lo), 9) as s_acctbal from supplier, (select min(s_acctbal) lo, max(s_acctbal) hi from supplier)")
def pipeline_normalize(spark, d):
    out = pipeline.process(t(spark, d, "supplier"), [{"type": "normalize", "columns": ["s_acctbal"]}, {"type": "select", "columns": ["s_suppkey", "s_acctbal"]}])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 9))


@query("select (count(c_name) + count(c_acctbal))::double / (2 * count(*)) as completeness, false as warn from customer")
def completeness(spark, d):
    return quality.completeness(t(spark, d, "customer"), ["c_name", "c_acctbal"])


@query("select doc_id, round(1.0 - case when length(text) < 10 then 0.3 else 0 end - case when regexp_matches(text, '\\p{L}') and (text = upper(text) or text = lower(text)) then 0.1 else 0 end, 4) as quality from documents")
def text_quality(spark, d):
    return t(spark, d, "documents").select("doc_id", quality.text_quality(F.col("text")).alias("quality"))


@query("select 'unique:o_custkey' as \"constraint\", o_orderkey::varchar as id from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) > 1) union all select 'custom:big', o_orderkey::varchar from orders where o_totalprice > 400000")
def constraint_violations(spark, d):
    return quality.violations(t(spark, d, "orders"), "o_orderkey", exists=("o_orderstatus",), types={"o_orderkey": "bigint"}, unique=("o_custkey",), custom={"big": F.when(F.col("o_totalprice") > 400000, "too big")}).select("constraint", "id")


@query("select case when o_orderstatus = 'F' then 'finished' when o_totalprice < 50000 then 'small' end as reason, count(*) as n from orders group by 1")
def drop_reasons(spark, d):
    return quality.drop_reasons(t(spark, d, "orders"), {"finished": F.col("o_orderstatus") == "F", "small": F.col("o_totalprice") < 50000}).groupBy("reason").agg(F.count("*").alias("n"))


@query("select quality as actual, count(*) filter (toxic = 1) as toxic, count(*) as n from labels group by 1")
def label_counts(spark, d):
    return t(spark, d, "labels").groupBy(F.col("quality").alias("actual")).agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("n"))


@query("with p as (select quality as a, case when n_chars > 2000 then 1 else 0 end as p from labels join documents using (doc_id)), c as (select count(*) filter (a = 1 and p = 1) as tp, count(*) filter (a = 0 and p = 1) as fp, count(*) filter (a = 1 and p = 0) as fn, count(*) filter (a = 0 and p = 0) as tn from p) select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c")
def confusion_matrix(spark, d):
    both = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = stats.confusion(both, F.col("quality"), (F.col("n_chars") > 2000).cast("int"))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


# ---- statistics ------------------------------------------------------------------------------------------
@query("select event_type, list_sort(list(value))[1 + round_even(0.95 * (count(*) - 1), 0)::int] as p95 from events group by 1")
def p95_nearest_rank(spark, d):
    return stats.exact_percentile(t(spark, d, "events"), ["event_type"], "value", 0.95).withColumnRenamed("percentile", "p95")


@query("select event_type, list_sort(list(value))[1 + floor(0.9 * (count(*) - 1))::int] as p90 from events group by 1")
def percentile_lower(spark, d):
    return stats.exact_percentile(t(spark, d, "events"), ["event_type"], "value", 0.9, "lower").withColumnRenamed("percentile", "p90")


@query("select event_type, round(quantile_cont(value, 0.75), 6) as p75 from events group by 1")
def percentile_interpolated(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.75), 6).alias("p75"))


@query("select b.bin::int as bin, count(v) as n from range(10) b(bin) left join (select least(floor(l_discount * 10), 9) as v from lineitem where l_discount between 0 and 1) on v = b.bin group by 1")
def histogram(spark, d):
    return stats.histogram(t(spark, d, "lineitem"), F.col("l_discount"), 10)


@query("select 'l_quantity' as dimension, round(avg(l_quantity), 6) as mean, min(l_quantity) as min, max(l_quantity) as max, round(stddev_samp(l_quantity), 6) as stdev from lineitem union all select 'l_tax', round(avg(l_tax), 6), min(l_tax), max(l_tax), round(stddev_samp(l_tax), 6) from lineitem")
def summary_stats(spark, d):
    return stats.summary(t(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query("with s as (select c_nationkey as k, count(*) as n from customer group by 1), q as (select k, least(n, greatest(floor(n * 100 / (select count(*)::double from customer)), 1)) as q from s), r as (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by md5(c_custkey::varchar), c_custkey) as rn from customer) select c_custkey, c_nationkey from r join q on k = c_nationkey where rn <= q")
def stratified_sample(spark, d):
    return stats.stratified_sample(t(spark, d, "customer"), "c_nationkey", "c_custkey", 100).select("c_custkey", "c_nationkey")


@query("select event_id, count(*) over w as n, round(avg(value) over w, 6) as mean from events window w as (partition by event_type order by epoch_us(ts) range between 300000000 preceding and current row)")
def trailing_metrics_5m(spark, d):
    return stats.trailing(t(spark, d, "events"), ["event_type"], "ts", "value", 300).select("event_id", "n", F.round("mean", 6).alias("mean"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 85999999999 preceding and current row) > 3 as over from events")
def rate_limit_window(spark, d):
    return stats.over_limit(t(spark, d, "events"), "user_id", "ts", 3, 86000).select("event_id", "over")


@query("""with recursive o as (select user_id, ts, row_number() over (partition by user_id order by ts) as rn from events),
let_in(user_id, ts, rn, held, allowed) as (
  select user_id, ts, rn, [ts], true from o where rn = 1
  union all select o.user_id, o.ts, o.rn, case when len([x for x in held if x > o.ts - interval 1 day]) < 3 then list_append([x for x in held if x > o.ts - interval 1 day], o.ts) else [x for x in held if x > o.ts - interval 1 day] end, len([x for x in held if x > o.ts - interval 1 day]) < 3
  from let_in l join o on o.user_id = l.user_id and o.rn = l.rn + 1)
select user_id, ts, allowed from let_in""")
def rate_limit_exact(spark, d):
    return stats.rate_limit(t(spark, d, "events"), "user_id", "ts", 3, 86400)


@query("select event_id, lag(value) over w as previous, value - lag(value) over w as delta from events window w as (partition by user_id order by ts)")
def lag_delta(spark, d):
    return stats.delta(t(spark, d, "events"), "user_id", "ts", "value").select("event_id", "previous", "delta")


@query("select event_id, value, row_number() over (order by value, event_id) as rank from events")
def global_rank(spark, d):
    return stats.global_rank(t(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query("select 'o_orderstatus' as field, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def facets(spark, d):
    return stats.facets(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select source as source, count(*) as n from documents group by 1 order by n desc, source limit 10")
def top_counts(spark, d):
    return stats.top_counts(t(spark, d, "documents"), "source", 10)


_PROVIDER = "select event_type as provider, 'op' as operation, user_id % 10 > 0 as success, value as latency_ms, 1 as items, case when user_id % 3 = 0 then value / 100 end as quality from events"


def _provider(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr("event_type as provider", "'op' as operation", "user_id % 10 > 0 as success", "value as latency_ms", "1 as items", "case when user_id % 3 = 0 then value / 100 end as quality")


@query(f"with e as ({_PROVIDER}) select provider, operation, count(*) as total, count(*) filter (success) as successes, count(*) filter (not success) as failures, round(count(*) filter (success) / count(*), 6) as success_rate, round(avg(latency_ms), 6) as avg_latency_ms, list_sort(list(latency_ms))[1 + round_even(0.95 * (count(*) - 1), 0)::int] as p95_latency_ms, sum(items)::bigint as items, round(sum(items) / 3600.0, 6) as throughput, round(avg(quality), 6) as avg_quality from e group by 1, 2")
def provider_snapshot(spark, d):
    out = stats.provider_snapshot(_provider(spark, d), 3600)
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_latency_ms", "throughput", "avg_quality")})


@query(f"with e as ({_PROVIDER}), s as (select provider, count(*) filter (success) / count(*) as ok, avg(latency_ms) as lat, sum(items) / 3600.0 as thr, coalesce(avg(quality), 0) as q from e group by 1) select provider, round(0.4 * greatest(0, least(1, thr / 2)) + 0.3 * ok + 0.2 * greatest(0, least(1, 1 - lat / 500)) + 0.1 * greatest(0, least(1, q)), 6) as score from s")
def provider_score(spark, d):
    snap = stats.provider_snapshot(_provider(spark, d), 3600)
    out = stats.provider_score(snap, {"throughput": 0.4, "success_rate": 0.3, "latency": 0.2, "quality": 0.1}, {"throughput": 2.0, "latency": 500.0, "cost": 1.0})
    return out.select("provider", F.round("score", 6).alias("score"))


@query("with c as (select l_shipdate::date as day, count(*) as n from lineitem group by 1 having count(*) >= 10), u as (select day, n, ('0x' || substr(sha256('s|' || day::varchar), 1, 13))::bigint / 4503599627370496.0 - 0.5 as c from c) select day, n, round(greatest(0, n - 2.0 * sign(c) * ln(1 - 2 * abs(c))), 6) as noisy from u")
def cohort_counts(spark, d):
    days = t(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return stats.cohort_counts(days, "day", 10, 0.5, 1.0, "s").withColumn("noisy", F.round("noisy", 6))


@query("select event_id, round((value - m) / s, 6) as z from events, (select avg(value) m, stddev_samp(value) s from events) where abs((value - m) / s) > 1.5")
def outliers(spark, d):
    return stats.outliers(t(spark, d, "events"), "value", 1.5).select("event_id", F.round("z", 6).alias("z"))


@query("select o_orderpriority as \"group\", round(corr(o_totalprice, o_custkey), 6) as r from orders group by 1")
def correlations(spark, d):
    return etl.correlations(t(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey").select(F.col("o_orderpriority").alias("group"), F.round("r", 6).alias("r"))


@query("select lower(role) as key, min_by(turn, conv_id * 1000 + turn) as id, count(*) as n_mentions, count(distinct conv_id) as n_docs from conversations group by 1")
def cluster_mentions(spark, d):
    m = t(spark, d, "conversations").select(F.col("turn").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("role").alias("text"), F.lit("role").alias("label"), F.col("conv_id").alias("doc_id"), F.lit(1.0).alias("confidence"))
    return etl.cluster_mentions(m).select("key", "id", "n_mentions", "n_docs")


@query("select conv_id, count(*) as n_turns, count(distinct role) as n_roles, sum(length(text))::bigint as n_chars from conversations group by 1")
def thread_stats(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.sum(F.length("text")).alias("n_chars"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2")
def windowed_metrics(spark, d):
    return metrics.windowed(t(spark, d, "events"), "ts", ["event_type"], "value", "1 hour").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as start, max(ts) + interval 30 minute as \"end\", count(*) as n from s group by user_id, s")
def session_metrics(spark, d):
    return metrics.sessions(t(spark, d, "events"), "ts", "user_id")


# ---- text ------------------------------------------------------------------------------------------------------
@query("with w as (select doc_id, [x for x in regexp_extract_all(lower(text), '[a-z0-9]+') if length(x) >= 3] as words from documents) select doc_id, len(words)::bigint as n, sha256(array_to_string(words, ' ')) as h from w")
def tokens(spark, d):
    words = t(spark, d, "documents").select("doc_id", T.tokens(F.col("text"), 3).alias("words"))
    return words.select("doc_id", F.size("words").cast("bigint").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("h"))


@query("select doc_id, sha256(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), '    '), ' +', ' ', 'g')) as h from documents")
def text_normalise(spark, d):
    c = T.whitespace(T.line_endings(F.col("text")))
    return t(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("h"))


@query("select sha256(text) as h, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedup_exact(spark, d):
    docs = t(spark, d, "documents")
    kept = etl.exact_dedup(docs.select("doc_id", "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name")), "text", "name")
    n = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies"))
    return kept.select(F.sha2("text", 256).alias("h"), "doc_id").join(n, "h")


@query("select doc_id, source from (select doc_id, source, 0 as p from documents where doc_id % 2 = 0 union all select doc_id, 'late', 1 from documents) qualify row_number() over (partition by doc_id order by p) = 1")
def dedup_first_wins(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return etl.first_wins([docs.filter("doc_id % 2 = 0"), docs.withColumn("source", F.lit("late"))], "doc_id")


@query("select a.item_id as a, b.item_id as b, round(len(list_intersect(list_distinct(string_split_regex(lower(a.text), '\\s+')), list_distinct(string_split_regex(lower(b.text), '\\s+')))) / len(list_distinct(list_concat(string_split_regex(lower(a.text), '\\s+'), string_split_regex(lower(b.text), '\\s+')))), 6) as j from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def jaccard_pairs(spark, d):
    b = t(spark, d, "benchmark")
    x, y = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")), b.select(F.col("item_id").alias("b"), F.col("text").alias("tb"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.jaccard(F.col("ta"), F.col("tb")), 6).alias("j"))


@query("select doc_id, i as chunk, sha256(substr(text, i::int * 900 + 1, 1000)) as h from documents, range(0, (greatest(length(text) - 101, 0) // 900) + 1) r(i) where length(text) > 0")
def chunk_fixed(spark, d):
    out = pipeline.process(t(spark, d, "documents").select("doc_id", "text"), [{"type": "chunk", "column": "text"}])
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.sha2("text", 256).alias("h"))


@query("select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
def html_title(spark, d):
    return t(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _a, _b in _ENTITIES:
    _BARE = f"replace({_BARE}, '{_a}', '{_b}')"


@query(f"select page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) as text, [trim(regexp_replace(x, '(?s)<[^>]+>', '', 'g')) for x in regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)] as headings from pages")
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"), T.html_headings(F.col("html")).alias("headings"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') as domain, sha256(regexp_replace(trim(url), '#.*$', '')) as key from pages")
def url_domain(spark, d):
    return t(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"), T.url_key(F.col("url")).alias("key"))


@query("select doc_id, (('0x' || substr(sha256(doc_id::varchar), 1, 16))::ubigint % 16)::bigint as shard from documents")
def shard_assign_sha256(spark, d):
    return t(spark, d, "documents").select("doc_id", T.shard_index(F.col("doc_id").cast("string"), 16).alias("shard"))


@query("select vec_id, least((row_number() over (order by vec_id) - 1) // greatest(1, (select count(*) from embeddings) // 7), 6)::bigint as shard from embeddings")
def shard_balanced(spark, d):
    return retrieval.balanced_shards(t(spark, d, "embeddings").select("vec_id"), "vec_id", 7)


_RING = "places as (select ('0x' || substr(h, 1, 16))::ubigint as at, row_number() over (order by h, node) as rn, node from (select md5('node' || n || ':' || i) as h, 'node' || n as node from range(5) a(n), range(150) b(i))), docs as (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 16))::ubigint as at from documents)"


@query(f"with {_RING}, seen as (select doc_id, node, min(case when p.at > d.at then p.rn else p.rn + 750 end) as first from docs d, places p group by 1, 2) select doc_id, list(node order by first)[1:3] as shards from seen group by 1")
def shard_ring(spark, d):
    return retrieval.ring_assign(t(spark, d, "documents").select("doc_id"), "doc_id", [f"node{i}" for i in range(5)])


@query("select doc_id, length(text) - length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '', 'g')) > 0 as had_email from documents")
def sanitise(spark, d):
    out = T.sanitise(F.col("text"))
    return t(spark, d, "documents").withColumn("clean", out["text"]).select("doc_id", F.col("clean").contains("[EMAIL]").alias("had_email"))


@query()
def entity_rules(spark, d):
    return T.extract_entities(t(spark, d, "documents"))


@query()
def relation_rules(spark, d):
    return T.extract_relations(t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))


@query("select doc_id, lang, source, n_chars, sha256(text) as h from documents where lower(text) like '%license%' or lower(source) like '%license%' order by doc_id limit 20")
def like_search(spark, d):
    return etl.like_search(t(spark, d, "documents"), ["text", "source"], "License", "doc_id", 20).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h"))


@query("select doc_id, (case when text ilike '%idiot%' then 1 else 0 end + case when text ilike '%license%' then 1 else 0 end)::int as n from documents")
def keyword_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", quality.keyword_count(F.col("text"), ["Idiot", "license"]).alias("n"))


# ---- retrieval --------------------------------------------------------------------------------------------------------
_QUERY = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]
_QUERY_SQL = "[" + ", ".join(map(str, _QUERY)) + "]::double[]"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(f"select vec_id as id, round(1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), 6) as distance from embeddings order by 1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), vec_id limit 10")
def vector_topk(spark, d):
    return retrieval.vector_topk(_vectors(spark, d), _QUERY, 10).withColumn("distance", F.round("distance", 6))


@query(f"select vec_id as id, round(list_distance(embedding::double[], {_QUERY_SQL}), 6) as distance from embeddings order by list_distance(embedding::double[], {_QUERY_SQL}), vec_id limit 10")
def vector_topk_l2(spark, d):
    return retrieval.vector_topk(_vectors(spark, d), _QUERY, 10, "l2").withColumn("distance", F.round("distance", 6))


@query(f"select vec_id as id, round(1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), 6) as distance from embeddings where list_cosine_similarity(embedding::double[], {_QUERY_SQL}) >= 0.1 order by 1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), vec_id limit 50")
def vector_threshold(spark, d):
    return retrieval.vector_topk(_vectors(spark, d), _QUERY, 50, threshold=0.1).withColumn("distance", F.round("distance", 6))


@query("select q.vec_id as qid, e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 5) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], e.embedding::double[]) desc, e.vec_id) <= 3")
def vector_topk_many(spark, d):
    v = _vectors(spark, d)
    out = retrieval.vector_topk_many(v, v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 3)
    return out.select("qid", "id", F.round("score", 5).alias("score"))


@query("with b as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), s as (select doc_id, len(w) as dl, [x for x in w if x in ('license', 'the', 'idiot')] as h from b), tot as (select count(*)::double as n, avg(dl) as mean from s), tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(h) as term from s) group by all), df as (select term, count(*) as df from tf group by 1) select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) as score from tf join df using (term), tot group by doc_id order by sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) desc, doc_id limit 10")
def bm25_topk(spark, d):
    return retrieval.bm25(t(spark, d, "documents"), "the idiot License", 10).select("doc_id", F.round("score", 6).alias("score"))


_VECTOR_50 = f"select vec_id as id, list_cosine_similarity(embedding::double[], {_QUERY_SQL}) as score from embeddings order by 1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), vec_id limit 50"
_BM25_50 = "select doc_id as id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score from tf join df using (term), tot group by doc_id order by score desc, doc_id limit 50"
_BM25 = "b as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), s as (select doc_id, len(w) as dl, [x for x in w if x in ('license', 'the')] as h from b), tot as (select count(*)::double as n, avg(dl) as mean from s), tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, dl, unnest(h) as term from s) group by 1, 2, 3), df as (select term, ln(1 + ((select n from tot) - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf group by 1)"


@query(f"with {_BM25}, v as ({_VECTOR_50}), l as ({_BM25_50}), vs as (select id, (score - min(score) over ()) / (max(score) over () - min(score) over ()) as x from v), ls as (select id, (score - min(score) over ()) / (max(score) over () - min(score) over ()) as x from l) select id, round(0.6 * coalesce(vs.x, 0) + 0.4 * coalesce(ls.x, 0), 6) as score from vs full join ls using (id) order by 0.6 * coalesce(vs.x, 0) + 0.4 * coalesce(ls.x, 0) desc, id limit 10")
def hybrid_topk(spark, d):
    v = retrieval.vector_topk(_vectors(spark, d), _QUERY, 50).select("id", (1 - F.col("distance")).alias("score"))
    lex = retrieval.bm25(t(spark, d, "documents"), "license the", 50).select(F.col("doc_id").alias("id"), "score")
    return retrieval.hybrid(v, lex, 0.6, 10).withColumn("score", F.round("score", 6))


@query("with s as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[0-9]+'))  as t from documents) select doc_id as id, round(len(list_intersect(t, ['1', '2', '2024'])) / greatest(len(t), 3), 6) as score from s where len(list_intersect(t, ['1', '2', '2024'])) > 0 order by len(list_intersect(t, ['1', '2', '2024'])) / greatest(len(t), 3) desc, doc_id limit 20")
def sparse_overlap(spark, d):
    items = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9]+"), F.lit(0))).alias("indices"))
    found = retrieval.sparse_search(items, ["1", "2", "2024"], 20)
    return found.select("id", F.round("score", 6).alias("score"))


@query("select doc_id % 3 as engine, doc_id as rank, source as url, n_chars as score from documents qualify row_number() over (partition by source order by n_chars desc, doc_id % 3, doc_id) = 1")
def merge_engines(spark, d):
    r = t(spark, d, "documents").select((F.col("doc_id") % 3).alias("engine"), F.col("doc_id").alias("rank"), F.col("source").alias("url"), F.col("n_chars").alias("score"))
    return retrieval.merge_engines(r, "merge", 10**6)


@query()
def kmeans_clusters(spark, d):
    return stats.kmeans(_vectors(spark, d), 5)


# ---- scalar functions over constants -------------------------------------------------------------------------------------
@query("select 'range_up' as f, '0,2,4' as v union all select 'range_down', '5,3' union all select 'range_none', '' union all select 'head', '7' union all select 'last', '9' union all select 'tail', '8,9' union all select 'substring', 'bc' union all select 'reverse', 'cba'")
def scalar_functions(spark, d):
    a = F.array(F.lit(7), F.lit(8), F.lit(9))
    s = lambda c: F.array_join(c.cast("array<string>"), ",")
    rows = {"range_up": s(R.range_(F.lit(0), F.lit(6), F.lit(2))), "range_down": s(R.range_(F.lit(5), F.lit(1), F.lit(-2))), "range_none": s(R.range_(F.lit(3), F.lit(3))), "head": R.head(a).cast("string"), "last": R.last(a).cast("string"), "tail": s(R.tail(a)), "substring": R.substring(F.lit("abcd"), F.lit(1), F.lit(2)), "reverse": R.call("reverse", F.lit("abc"))}
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("f"), v.alias("v")) for k, v in rows.items()))))


@query("select a.n_nationkey as a, b.n_nationkey as b, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.n_nationkey * 7 - a.n_nationkey * 7) / 2), 2) + cos(radians(a.n_nationkey * 7 - 80)) * cos(radians(b.n_nationkey * 7 - 80)) * pow(sin(radians((b.n_nationkey - a.n_nationkey) * 13) / 2), 2)))), 4) as km from nation a join nation b on true where 2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.n_nationkey * 7 - a.n_nationkey * 7) / 2), 2) + cos(radians(a.n_nationkey * 7 - 80)) * cos(radians(b.n_nationkey * 7 - 80)) * pow(sin(radians((b.n_nationkey - a.n_nationkey) * 13) / 2), 2)))) <= 2000")
def radius_join(spark, d):
    k = F.col("n_nationkey")
    p = t(spark, d, "nation").select(k.alias("id"), (k * 7 - 80).cast("double").alias("lat"), (F.pmod(k * 13 + 180, F.lit(360)) - 180).cast("double").alias("lon"))
    return etl.within_radius(p, p, 2000.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round("km", 4).alias("km"))


@query("select a.event_id as a_id, b.event_id as b_id from events a join events b on a.event_type = 'signup' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval 60 second")
def window_join(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "event_type")
    return etl.window_pairs(e.filter("event_type = 'signup'"), e.filter("event_type = 'purchase'"), 60).select("a_id", "b_id")


@query("select o_orderstatus as g, count(distinct o_orderpriority) as n_families, case when count(distinct o_orderpriority) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) = 2 then 'full' when count(distinct o_orderpriority) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) > 0 then 'partial' else 'none' end as coverage from orders group by 1")
def coverage_rollup(spark, d):
    o = t(spark, d, "orders")
    c = etl.coverage(o, "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderstatus", "coverage")
    n = o.groupBy("o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("n_families"))
    return c.join(n, "o_orderstatus").select(F.col("o_orderstatus").alias("g"), "n_families", "coverage")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def key_audit(spark, d):
    return etl.key_audit({"documents": t(spark, d, "documents"), "labels": t(spark, d, "labels")}, "doc_id").select("doc_id")


@query("select n_regionkey::varchar as ontology_id, round(0.3 * least(count(*) / 10.0, 1) + 0.3 * 1.0 + 0.2 * least(1 / 3.0, 1) + 0.2, 4) as completeness from nation group by 1")
def critic_completeness(spark, d):
    n = t(spark, d, "nation")
    e = n.select(F.col("n_regionkey").cast("string").alias("ontology_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.lit("location").alias("type"), F.col("n_name").alias("text"))
    r = n.select(F.col("n_regionkey").cast("string").alias("ontology_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("source_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("target_id"), F.lit("part_of").alias("type"))
    return quality.critic_completeness(e, r)
