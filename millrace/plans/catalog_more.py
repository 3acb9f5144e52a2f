"""More registered queries: text functions, records, retrieval, round trips, critics, templates, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry as R
from millrace.functions import text as T
from millrace.operators import etl, lineage, quality, retrieval, stats
from millrace.operators.graph import Graph, beam
from millrace.plans import ir, triples
from millrace.plans.catalog import _ALL_EDGES, _NODES, _QUERY, _QUERY_SQL, _vectors, g, query, t
from millrace.plans.cypher import cypher
from millrace.plans.cypher_write import cypher_write
from millrace.shared import shared_dir, write_table
from millrace.sources import io


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


# ---- graph query language ---------------------------------------------------------------------------
@query(
    """with recursive e as (select 'Nation:' || n_nationkey as src, 'Region:' || n_regionkey as dst, 'IN_REGION' as k from nation union all select 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'BASED_IN' from supplier),
    b as (select src as a, dst as b, src || dst as key from e union all select dst, src, src || dst from e),
    w(start, here, used, n) as (select 'Region:' || r_regionkey, 'Region:' || r_regionkey, []::varchar[], 0 from region union all select start, b.b, list_append(used, key), n + 1 from w join b on b.a = here where n < 3 and not list_contains(used, key))
    select r_name as name, count(*) as n, count(distinct here) as nodes from w join region on start = 'Region:' || r_regionkey where n >= 1 group by 1"""
)
def cypher_varlen(spark, d):
    return cypher(g(spark, d), "MATCH (r:Region)-[:IN_REGION|BASED_IN*1..3]-(x) RETURN r.name AS name, COUNT(x) AS n, COUNT(DISTINCT x.id) AS nodes")


@query("select c_name as name from customer where (contains(c_name, '7') or ends_with(c_name, '01')) and not starts_with(c_name, 'x') and c_mktsegment <> 'a.name' and c_custkey > 3")
def cypher_strings(spark, d):
    return cypher(g(spark, d), "MATCH (c:Customer) WHERE (c.name CONTAINS '7' OR c.name ENDS WITH '01') AND NOT c.name STARTS WITH $no AND c.segment <> 'a.name' AND c.id <> 'Customer:1' AND c.id <> 'Customer:2' AND c.id <> 'Customer:3' AND c.id <> 'Customer:0' RETURN c.name AS name", {"no": "x"})


@query("select c_custkey::varchar as id, c_name as \"c.name\" from customer where c_acctbal < length(c_name)")
def cypher_property_compare(spark, d):
    out = cypher(g(spark, d), "MATCH (c:Customer) WHERE c.acctbal < length(c.name) RETURN c.id AS id, c.name")
    return out.withColumn("id", F.split("id", ":")[1])


@query("select 'n' as kind, n from (select count(*) as n from nation union select count(*) from region union select 25)")
def cypher_union_aggregates(spark, d):
    q = "MATCH (a:Nation) RETURN 'n' AS kind, COUNT(a) AS n UNION MATCH (a:Region) RETURN 'n' AS kind, COUNT(a) AS n UNION MATCH (a:Nation) RETURN 'n' AS kind, COUNT(a) AS n"
    return cypher(g(spark, d), q)


@query("select 'Nation:' || n_nationkey as id, 'IN_REGION' as kind, ['Nation'] as labels, ['name'] as keys, null::varchar as nothing from nation")
def cypher_introspection(spark, d):
    out = cypher(g(spark, d), "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN id(n) AS id, type(e) AS kind, labels(n) AS labels, keys(n) AS keys, no_such_function(n.name) AS nothing")
    return out.withColumn("nothing", F.col("nothing").cast("string"))


@query("select 'Nation:' || n_nationkey as id, case when n_nationkey = 3 then 'merged' else n_name end as name, case when n_nationkey % 2 = 0 then 'even' end as kind from nation union all select 'Nation:new', 'made', null union all select 'Region:' || r_regionkey, null, null from region")
def cypher_merge_set(spark, d):
    a = g(spark, d)
    a = cypher_write(a, "MERGE (n:Nation {id: 'Nation:3'}) ON CREATE SET n.name = 'made' ON MATCH SET n.name = 'merged'")
    a = cypher_write(a, "MERGE (n:Nation {id: $id}) ON CREATE SET n.name = 'made' ON MATCH SET n.name = 'merged'", {"id": "Nation:new"})
    a = cypher_write(a, "MATCH (n:Nation) WHERE n.id IN $even SET n.kind = 'even'", {"even": [f"Nation:{i}" for i in range(0, 25, 2)]})
    a = cypher_write(a, "MATCH (r:Region) REMOVE r.name")
    return a.nodes.filter(F.array_contains("labels", "Nation") | F.array_contains("labels", "Region")).select("id", "name", "kind")


@query(f"with {_NODES}, {_ALL_EDGES}, gone as (select 'Supplier:' || s_suppkey as id from supplier where s_acctbal > 5000) select type, count(*) as n from e where not (type = 'LIVES_IN' and dst = 'Nation:1') and src not in (select id from gone) and dst not in (select id from gone) group by 1 union all select 'IN_ZONE', count(*) from region")
def cypher_create_delete(spark, d):
    a = g(spark, d)
    a = cypher_write(a, "CREATE (z:Zone {id: 'Zone:1', name: 'all'})")
    a = cypher_write(a, "MATCH (r:Region), (z:Zone) CREATE (r)-[:IN_ZONE]->(z)")
    a = cypher_write(a, "MATCH (r:Region), (z:Zone) MERGE (r)-[:IN_ZONE]->(z)")
    a = cypher_write(a, "MATCH (c:Customer)-[l:LIVES_IN]->(n:Nation) WHERE n.id = 'Nation:1' DELETE l")
    a = cypher_write(a, "MATCH (s:Supplier) WHERE s.acctbal > 5000 DETACH DELETE s")
    return a.edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"with {_NODES}, {_ALL_EDGES}, near as (select 'Nation:3' as id union select dst from e where src = 'Nation:3' union select src from e where dst = 'Nation:3') select src, dst, type from e where src in (select id from near) and dst in (select id from near)")
def graph_focus(spark, d):
    return g(spark, d).focus("Nation:3", 1).edges.select("src", "dst", "type")


@query("select 'Region:' || r_regionkey as id, r_name as name from region where r_name = 'ASIA' or r_regionkey = 1")
def find_nodes(spark, d):
    graph = g(spark, d)
    return graph.scan("Region", name="ASIA").union(graph.seeds(["Region:1"])).select("id", "name").distinct()


@query(f"with {_ALL_EDGES}, b as (select distinct 'Region:' || r_regionkey as id from region) select id, 'Region' as type, (select r_name from region where 'Region:' || r_regionkey = id) as name from b order by id limit 3")
def ir_seeds_budget(spark, d):
    steps = ir.QueryIR.from_ops([ir.SeedEntities(tuple(f"Nation:{i}" for i in range(25))), ir.Expand(("IN_REGION",), "out"), ir.Limit(3), ir.Project()])
    return ir.execute(g(spark, d), steps, ir.preset("strict"))


@query("with p as (select distinct 'Part:' || l_partkey as s, 'Supplier:' || l_suppkey as o from lineitem) select s from p where o = 'Supplier:3' order by s limit 100")
def template_inverse(spark, d):
    edges = g(spark, d).edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    return triples.inverse(edges, "Supplier:3", "SUPPLIED_BY").orderBy("s").limit(100)


@query("select distinct 'Region:' || n_regionkey as o from customer join nation on n_nationkey = c_nationkey where c_custkey = 7")
def template_path(spark, d):
    edges = g(spark, d).edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    return triples.path(edges, "Customer:7", ["LIVES_IN", "IN_REGION"])


@query(f"with {_ALL_EDGES} select type as p, count(*) as n, count(distinct src) as subjects from e group by 1")
def template_predicates(spark, d):
    edges = g(spark, d).edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    return triples.predicate_counts(edges)


@query("select 'Region:' || r_regionkey as id, r_name as name, (select list(n_name order by n_name) from nation where n_regionkey = r_regionkey) as nations from region")
def graphql_nested(spark, d):
    whole = g(spark, d)
    turned = Graph(whole.nodes, whole.directed(["IN_REGION"], "in"))
    out = triples.graphql(turned, "{ Region { id name IN_REGION { name } } }")
    return out.select("id", "name", F.transform("IN_REGION", lambda x: x["name"]).alias("nations"))


@query("select 'Nation:' || a.n_nationkey as src, 'Nation:' || b.n_nationkey as dst, 1.0::double as score from nation a join nation b on a.n_regionkey = b.n_regionkey and 'Nation:' || a.n_nationkey < 'Nation:' || b.n_nationkey order by src, dst limit 20")
def suggest_edges(spark, d):
    whole = g(spark, d)
    return Graph(whole.scan("Nation").union(whole.scan("Region")), whole.edges.filter("type = 'IN_REGION'")).suggest(0.5, 20)


@query("with recursive sub as (select 'Nation:' || n_nationkey as a, 'Region:' || n_regionkey as b from nation union all select 'Region:' || r_regionkey, 'World' from region), up(a, b) as (select a, b from sub union select up.a, sub.b from up join sub on up.b = sub.a), ty as (select 'Supplier:' || s_suppkey as a, 'Nation:' || s_nationkey as b from supplier) select a as src, b as dst, 'subClassOf' as type from up union select a, b, 'type' from ty union select ty.a, up.b, 'type' from ty join up on ty.b = up.a")
def ontology_materialise(spark, d):
    e = g(spark, d).edges
    sub = e.filter("type = 'IN_REGION'").withColumn("type", F.lit("subClassOf"))
    world = sub.select(F.col("dst").alias("src"), F.lit("World").alias("dst"), F.lit("subClassOf").alias("type")).distinct()
    kinds = e.filter("type = 'BASED_IN'").withColumn("type", F.lit("type"))
    return Graph(g(spark, d).nodes, sub.select("src", "dst", "type").union(world).union(kinds.select("src", "dst", "type"))).materialise()


@query("select 'Region:' || r_regionkey as id, round((r_regionkey + (select avg(n_nationkey) from nation where n_regionkey = r_regionkey)) / 2, 6) as x from region")
def propagate_vectors(spark, d):
    whole = g(spark, d)
    inner = Graph(whole.nodes, whole.edges.filter("type = 'IN_REGION'"))
    vec = whole.nodes.filter(F.element_at("labels", 1).isin("Nation", "Region")).select("id", F.array(F.split("id", ":")[1].cast("double")).alias("vec"))
    return inner.propagate(vec).filter("id like 'Region%'").select("id", F.round(F.col("vec")[0], 6).alias("x"))


@query(f"with s as (select vec_id, list_cosine_similarity(embedding::double[], {_QUERY_SQL}) as x from embeddings), h1 as (select vec_id, x from s where vec_id in (1, 2, 3, 4) order by x desc, vec_id limit 2) select vec_id as id, 0 as hop, round(x, 6) as score from s where vec_id = 0 union all select vec_id, 1, round(x, 6) from h1")
def beam_search(spark, d):
    v = _vectors(spark, d)
    e = spark.sql("select 0 as src, id as dst, 'NEAR' as type from range(1, 5)")
    return beam(Graph(v.select("id"), e), spark.sql("select cast(0 as bigint) as id"), v, _QUERY, 2, 1).select("id", "hop", F.round("score", 6).alias("score"))


# ---- records and joins ------------------------------------------------------------------------------
_MAIL = "select conv_id * 1000 + turn as id, text as body_text, role as \"from\", 'team' as \"to\", left(text, 20) as subject, make_timestamp(((conv_id * 3600 + turn) * 1000000)::bigint) as date, case when turn > 0 then conv_id end as in_reply_to, turn % 3 as files from conversations"


def _mail(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations")
    files = F.transform(F.when(F.col("turn") % 3 > 0, F.sequence(F.lit(1), (F.col("turn") % 3).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct((i * 10).cast("long").alias("size")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body_text"), F.col("role").alias("from"), F.lit("team").alias("to"), F.left("text", F.lit(20)).alias("subject"), F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn")).alias("date"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("in_reply_to"), files.alias("attachments"))


@query(f"with m as ({_MAIL}), r as (select in_reply_to, count(*) as c from m where in_reply_to is not null group by 1) select count(*) as n, min(date) as earliest, max(date) as latest, sum(files)::bigint as n_attachments, sum(case files when 1 then 10 when 2 then 30 else 0 end)::bigint as attachment_bytes, trunc(avg(length(body_text)))::int as avg_body, (select count(*) from r) as n_threads, (select count(*) from r where c > 1) as n_long_threads from m")
def email_analytics(spark, d):
    return etl.email_analytics(_mail(spark, d))


@query(f"with m as ({_MAIL}) select id, 'from' as field from m where contains(lower(\"from\"), 'assist') union all select id, 'all' from m where contains(lower(concat_ws(' ', subject, \"from\", \"to\", body_text)), 'the ')")
def email_search(spark, d):
    m = _mail(spark, d)
    return etl.email_search(m, "ASSIST", "from").select("id", F.lit("from").alias("field")).union(etl.email_search(m, "The ").select("id", F.lit("all")))


@query("select doc_id, '[REDACTED]' as api_key, left(text, 128) as body, source as name from documents")
def redact_keys(spark, d):
    m = etl.redact(F.create_map(F.lit("Api_Key"), F.col("source"), F.lit("body"), F.col("text"), F.lit("name"), F.col("source")))
    return t(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.col("m")["Api_Key"].alias("api_key"), F.col("m")["body"].alias("body"), F.col("m")["name"].alias("name"))


@query("select c_custkey, round(c_acctbal / 100, 2) as lat, round(c_custkey / 7.0, 2) as lon, sha256(printf('%.6f|%.6f|%s', c_acctbal / 100, c_custkey / 7.0, c_name)) as commitment from customer")
def coarse_location(spark, d):
    lat, lon = F.col("c_acctbal") / 100, F.col("c_custkey") / 7.0
    c = etl.coarse(lat, lon)
    return t(spark, d, "customer").select("c_custkey", c["lat"].alias("lat"), c["lon"].alias("lon"), etl.location_commitment(lat, lon, F.col("c_name")).alias("commitment"))


@query("select c_custkey, n_name as nation from customer join nation on n_nationkey = c_nationkey where n_regionkey <> 2")
def lookup_join(spark, d):
    names = t(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return etl.lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey").select("c_custkey", "nation")


_MENTIONS = "select event_type as name, user_id as entity_id, event_id % 97 as doc_id, value / 100 as confidence from events"


@query(f"with m as ({_MENTIONS}), one as (select name, entity_id, count(*) as n, avg(confidence) as a from m group by 1, 2) select name, sum(n)::bigint as n_mentions, round(avg(a), 6) as confidence, (select count(distinct doc_id) from m where m.name = one.name) as n_docs from one group by name")
def merge_mentions(spark, d):
    m = t(spark, d, "events").selectExpr("event_type as name", "user_id as entity_id", "event_id % 97 as doc_id", "value / 100 as confidence")
    return etl.merge_mentions(m).withColumn("confidence", F.round("confidence", 6))


@query("select event_type as type, count(*) as n, round(avg(value / 100), 6) as mean, min(value / 100) as min, max(value / 100) as max, count(*) filter (value / 100 > 0.8) as high, count(*) filter (value / 100 between 0.6 and 0.8) as medium, count(*) filter (value / 100 < 0.6) as low from events group by 1")
def pattern_stats(spark, d):
    out = etl.pattern_stats(t(spark, d, "events").selectExpr("event_type as type", "value / 100 as confidence"))
    return out.withColumn("mean", F.round("mean", 6))


@query("select date_trunc('day', ts) as period, floor((user_id - 20) / (50.0 / 111.0))::bigint as cell_lat, floor(value / (50.0 / 111.0))::bigint as cell_lon, count(*) as n from events group by 1, 2, 3")
def spacetime_bins(spark, d):
    e = t(spark, d, "events").withColumn("lat", F.col("user_id") - 20).withColumn("lon", F.col("value"))
    return etl.bins(e, "ts", "lat", "lon")


@query("select event_id, event_type from events where event_type = 'error' order by ts, event_id limit 1")
def queue_next(spark, d):
    tasks = t(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "queued").otherwise("done").alias("status"), "event_type")
    return etl.queue_next(tasks).select(F.col("task_id").alias("event_id"), "event_type")


@query("select event_id, regexp_replace(event_type || user_id, '\\d+', '#', 'g') as title from events qualify row_number() over (partition by regexp_replace(event_type || user_id, '\\d+', '#', 'g') order by ts desc, event_id desc) = 1")
def newest_per_group(spark, d):
    e = t(spark, d, "events").withColumn("title", F.concat("event_type", F.col("user_id").cast("string")))
    return etl.newest_per_group(e, "title", "ts", "event_id").select("event_id", F.regexp_replace("title", r"\d+", "#").alias("title"))


@query("select min(doc_id) as doc_id from documents group by trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))")
def fuzzy_dedup(spark, d):
    return etl.fuzzy_dedup(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


_SIGNATURES = """w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents),
sh as (select doc_id, unnest(case when len(w) = 0 then [] else [array_to_string(w[i:i + 2], ' ') for i in range(1, greatest(len(w) - 2, 1) + 1)] end) as s from w),
h as (select doc_id, ('0x' || substr(sha1(s), 1, 16))::ubigint as h from sh),
bits as (select doc_id, i, 2 * sum((h >> i) & 1) >= count(*) as b from h, range(64) r(i) group by 1, 2),
sig as (select doc_id, coalesce((select sum(case when b then (1::hugeint << i) else 0 end) from bits where bits.doc_id = w.doc_id), 0)::ubigint as u from w)"""


@query(f"with {_SIGNATURES} select doc_id, printf('%016x', u) as fp from sig")
def simhash_signatures(spark, d):
    return etl.simhash64(t(spark, d, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))


@query(f"with recursive {_SIGNATURES}, f as materialized (select u, min(doc_id) as least from sig group by 1), link as materialized (select a.u as a, b.u as b from f a join f b on bit_count(xor(a.u, b.u)) <= 3), reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a), low as (select a as u, min(least) as group_id from reach join f on f.u = reach.b group by 1) select doc_id, group_id from sig join low using (u)")
def simhash_neardup(spark, d):
    return etl.simhash_groups(t(spark, d, "documents")).select("doc_id", "group_id")


# ---- statistics ----------------------------------------------------------------------------------------
@query("select count(*) as n, round(avg(value), 6) as avg, min(value) as min, max(value) as max, round(avg((user_id % 2)::double), 6) as hit_rate, round(avg(case when epoch(date_trunc('second', (select max(ts) from events))) - epoch(date_trunc('second', ts)) <= 300 then value end), 6) as recent_avg from events")
def query_log_stats(spark, d):
    log = t(spark, d, "events").select("ts", F.col("event_type").alias("pattern"), F.col("value").alias("seconds"), (F.col("user_id") % 2).alias("hit"))
    return stats.query_stats(log).withColumns({c: F.round(c, 6) for c in ("avg", "hit_rate", "recent_avg")})


@query("with s as (select user_id, arg_max(value, ts) - arg_min(value, ts) as change, 0.01 * count(*) as edge from events group by 1) select user_id, round(change, 6) as change, case when change > edge then 'improving' when change < -edge then 'degrading' else 'stable' end as trend from s")
def trend_by_user(spark, d):
    return quality.trend(t(spark, d, "events"), "user_id", "ts", "value").withColumn("change", F.round("change", 6))


@query("select o_orderkey, round(0.75 * o_totalprice / 499979 + 0.25 * (o_orderkey % 7) / 7.0, 6) as score, round((o_totalprice - 100000) * 100.0 / 100000, 6) as above from orders")
def reweighted_scores(spark, d):
    values = {"price": F.col("o_totalprice") / 499979, "key": (F.col("o_orderkey") % 7) / 7.0, "unused": F.lit(1.0)}
    return t(spark, d, "orders").select("o_orderkey", F.round(quality.reweight(values, {"price": 3, "key": 1, "unused": 0}), 6).alias("score"), F.round(quality.against_baseline(F.col("o_totalprice"), F.lit(100000.0)), 6).alias("above"))


@query("select o_orderkey::varchar as ontology_id, o_totalprice as overall, row_number() over (order by o_totalprice desc, o_orderkey::varchar) as rank from orders")
def ranked_results(spark, d):
    return quality.rank_by(t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ontology_id"), F.col("o_totalprice").alias("overall")))


@query("select 'neg' as error, count(*) as n, count(*) filter (user_id % 5 >= 4) as n_critical from events where value < 5 union all select 'odd', count(*), count(*) filter (user_id % 5 >= 4) from events where event_id % 2 = 1")
def error_summary(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 5).alias("severity"), F.when(F.col("value") < 5, 1).alias("neg"), F.when(F.col("event_id") % 2 == 1, 1).alias("odd"))
    return quality.error_summary(e, ["neg", "odd"])


@query("with h as (select event_id as id, props as line, unnest([x for x in [case when regexp_matches(props, '\"k\": 1') then 'one' end, case when regexp_matches(props, '9}') then 'nine' end] if x is not null]) as pattern from events) select pattern, count(*) as n, round(100.0 * count(*) / (select count(*) from events), 2) as percent, (list(left(line, 200) order by id))[1:3] as examples from h group by 1 having count(*) >= 2")
def error_patterns(spark, d):
    logs = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("line"))
    return quality.error_patterns(logs, {"one": '"k": 1', "nine": "9}"})


@query("select doc_id, 5 * (a::int) + 2 * (b::int) as score, [x for x in ['license', 'de'] if (x = 'license' and a) or (x = 'de' and b)] as matched from (select doc_id, list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'license') as a, lang = 'de' as b from documents)")
def field_relevance(spark, d):
    score, matched = quality.field_relevance(["license", "de"], {"text": (F.col("text"), 5.0), "lang": (F.col("lang"), 2.0)})
    out = t(spark, d, "documents").select("doc_id", "text", "lang")
    only = out.withColumn("text", F.array_join(F.filter(T.tokens(F.col("text")), lambda x: x == "license"), " "))
    return only.select("doc_id", score.alias("score"), matched.alias("matched"))


@query("select o_orderkey, case when (a > 8 and c > 0 and b > 0) or (a > 5 and b > 2 and c > 3) then 3 when ((a > 0 or b > 4) and b > 0) or c > 5 then 2 when a > 0 or c > 0 then 1 else 0 end as risk from (select o_orderkey, o_orderkey % 10 as a, o_custkey % 6 as b, (o_orderkey + o_custkey) % 8 as c from orders)")
def risk_levels(spark, d):
    a, b, c = F.col("o_orderkey") % 10, F.col("o_custkey") % 6, (F.col("o_orderkey") + F.col("o_custkey")) % 8
    return t(spark, d, "orders").select("o_orderkey", quality.risk_level(a, b, c, (a > 8).cast("int"), (b > 4).cast("int")).alias("risk"))


# ---- critics -------------------------------------------------------------------------------------------
def _ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions as ontologies: nations and suppliers as entities, where they lie as relationships."""
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    o = F.col("n_regionkey").cast("string").alias("ontology_id")
    one = lambda id_, kind, text, props, conf: [o, id_.alias("id"), F.lit(kind).alias("type"), text.alias("text"), props.alias("properties"), conf.alias("confidence")]
    none = F.create_map().cast("map<string,string>")
    e = n.select(*one(F.concat(F.lit("n"), "n_nationkey"), "location", F.col("n_name"), none, F.lit(0.5))).union(both.select(*one(F.concat(F.lit("s"), "s_suppkey"), "organization", F.col("s_name"), F.create_map(F.lit("name"), F.col("s_name")), F.when(F.col("s_acctbal") > 0, 0.9).otherwise(0.0))))
    r = n.select(o, F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.concat(F.lit("r"), "n_regionkey").alias("target_id"), F.lit("part_of").alias("type")).union(both.select(o, F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("located_in")))
    return e, r


_ONTOLOGY = "j as (select * from supplier join nation on s_nationkey = n_nationkey), c as (select n_regionkey as k, count(*) as n, (select count(*) from j where j.n_regionkey = nation.n_regionkey) as s from nation group by 1)"


@query(f"with {_ONTOLOGY} select k::varchar as ontology_id, round(0.5 * (1 - n / (2.0 * (n + s))) + 0.3 + 0.2, 4) as consistency from c")
def critic_consistency(spark, d):
    return quality.critic_consistency(*_ontology(spark, d))


@query(f"with {_ONTOLOGY} select k::varchar as ontology_id, round(0.35 * 1.0 * (0.7 * 0 + 0.3 * 1) + 0.2 + 0.25 * least(2.0 / case when n + s < 5 then 2 when n + s < 10 then 3 else 5 end, 1) + 0.2 * 1, 4) as coherence from c")
def critic_coherence(spark, d):
    return quality.critic_coherence(*_ontology(spark, d))


@query("with j as (select * from supplier join nation on s_nationkey = n_nationkey), e as (select n_regionkey as k, n_name as t, 0 as p, 0.5 as c from nation union all select n_regionkey, s_name, 1, case when s_acctbal > 0 then 0.9 else 0 end from j) select k::varchar as ontology_id, round(0.3 * avg(p) + 0.2 * greatest(avg(regexp_full_match(t, '[a-z][a-zA-Z0-9]*')::int), avg(regexp_full_match(t, '[a-z][a-z0-9_]*')::int), avg(regexp_full_match(t, '[A-Z][a-zA-Z0-9]*')::int)) + 0.2 * avg((t <> '')::int) + 0.2 * avg((c > 0)::int) - 0.1 * avg((length(trim(t)) < 3)::int), 4) as clarity from e group by 1")
def critic_clarity(spark, d):
    return quality.critic_clarity(_ontology(spark, d)[0])


@query(f"with {_ONTOLOGY} select k::varchar as ontology_id, round(0.45 * least(s / (n + s) / 3.0, 1) + 0.4 * least(1 / 1.5, 1) - 0.3 * n / (n + s), 4) as granularity from c")
def critic_granularity(spark, d):
    return quality.critic_granularity(*_ontology(spark, d))


@query(f"with {_ONTOLOGY} select k::varchar as ontology_id, round((n + s + 0) / (2.0 * (n + s)), 4) as alignment from c")
def critic_alignment(spark, d):
    return quality.critic_alignment(*_ontology(spark, d))


@query("with j as (select * from supplier join nation on s_nationkey = n_nationkey), e as (select n_regionkey::varchar as ontology_id, 'n' || n_nationkey as id, 'location' as type, n_name as text, 0.5 as c from nation union all select n_regionkey::varchar, 's' || s_suppkey, 'organization', s_name, case when s_acctbal > 0 then 0.9 else 0 end from j) select ontology_id, id, row_number() over (partition by ontology_id order by id, type, text, c desc) as place from e")
def ontology_sort(spark, d):
    return quality.sorted_entities(_ontology(spark, d)[0]).select("ontology_id", "id", "place")


# ---- text ----------------------------------------------------------------------------------------------
@query("select doc_id, i as sentence, sha256(s) as h from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as i from (select doc_id, [trim(x) for x in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if trim(x) <> ''] as l from documents))")
def chunk_sentences(spark, d):
    c = t(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), "sentence")).alias("i", "s"))
    return c.select("doc_id", F.col("i").cast("bigint").alias("sentence"), F.sha2("s", 256).alias("h"))


@query("select doc_id, i as part, sha256(s) as h from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as i from (select doc_id, [trim(x) for x in string_split_regex(text, '\\n\\s*\\n') if trim(x) <> ''] as l from documents))")
def chunk_paragraphs(spark, d):
    c = t(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), "paragraph")).alias("i", "s"))
    return c.select("doc_id", F.col("i").cast("bigint").alias("part"), F.sha2("s", 256).alias("h"))


@query("select doc_id, sha256(trim(regexp_replace(regexp_replace(text, '(?i)\\bthe license\\b|\\ball rights\\b', ' ', 'g'), '\\s+', ' ', 'g'))) as h from documents")
def without_phrases(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(T.without_phrases(F.col("text"), ("the license", "all rights")), 256).alias("h"))


@query("select page_id, regexp_extract(html, '(?is)<html lang=\"([a-z]+)\"', 1) as lang, coalesce(regexp_extract(html, '(?is)<meta\\s+name=[\"'']description[\"'']\\s+content=[\"''](.*?)[\"'']', 1), '') as description from pages")
def html_metadata(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", r'(?is)<html lang="([a-z]+)"', 1).alias("lang"), T.html_meta(F.col("html"), "description").alias("description"))


@query("select doc_id, substr(sha256(text), 1, 32) as content_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'none') as filled, array_to_string([x for x in [trim(regexp_replace(coalesce(lang, ''), '\\s+', ' ', 'g')), trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g'))] if x <> ''], chr(10)) as composed from documents")
def content_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"), T.first_filled(F.col("lang"), F.col("source"), default="none").alias("filled"), T.compose(F.col("lang"), F.col("source")).alias("composed"))


@query("select doc_id, case when count(*) over (partition by source) > 1 then source || '-' || substr(sha256(text), 1, 12) else source end as source from documents")
def disambiguated(spark, d):
    return T.disambiguate(t(spark, d, "documents").select("doc_id", "source", "text"), "source", "text").select("doc_id", "source")


@query("select lang, case lang when 'en' then 'english' when 'de' then 'german' else 'entity' end as name, count(*) as n from documents group by 1")
def label_maps(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", T.label_map(F.col("lang"), {"en": "english", "de": "german"}).alias("name"), "n")


_WORDS_OF = "select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as entity, item_id % 9 as sentence from benchmark"


@query(f"with m as ({_WORDS_OF}) select x.entity as a, y.entity as b, count(distinct x.sentence) as n_docs from m x join m y on x.sentence = y.sentence and x.entity < y.entity and abs(x.item_id - y.item_id) <= 9 group by 1, 2")
def sentence_cooccurrence(spark, d):
    m = t(spark, d, "benchmark").select((F.col("item_id") % 9).alias("doc_id"), F.col("item_id").alias("sentence"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("entity"))
    return T.sentence_cooccurrence(m, 9)


@query("select a.item_id as a, round((p + h + r + l) / 4, 6) as similarity from (select item_id, 1.0 as h, 1.0 as r, 1.0 as l, 1.0 as p from benchmark) a")
def structure_of_itself(spark, d):
    b = t(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("a"), F.round(T.structure_similarity(F.col("text"), F.col("text")), 6).alias("similarity"))


@query("select doc_id, case when len(h) > 0 then list_sort(list_distinct(flatten([[(('0x' || substr(sha256(w), 1 + 8 * k, 8))::bigint % 8192)::int for k in range(7)] for w in h]))) else [] end as bits, list_contains(h, 'license') as has from (select doc_id, list_distinct([x for x in regexp_extract_all(lower(text), '[a-z0-9]+') if x in ('license', 'the', 'und')]) as h from documents)")
def bloom_filters(spark, d):
    own = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: x.isin("license", "the", "und")))
    docs = t(spark, d, "documents").select("doc_id", T.bloom_bits(own).alias("bits"))
    return docs.select("doc_id", "bits", T.might_contain(F.col("bits"), F.lit("license")).alias("has"))


_PLACES = "select n_nationkey as doc_id, 'Nation ' || chr(65 + (n_nationkey % 26)::int) || 'ab' as a, 'Region ' || chr(65 + (n_regionkey % 26)::int) || 'cd' as b from nation"


@query(f"select doc_id, 'works_at_org' as relation, a as source, b as target from ({_PLACES})")
def relations_found(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("Nation "), F.char((F.col("n_nationkey") % 26 + 65).cast("int")), F.lit("ab joined Region "), F.char((F.col("n_regionkey") % 26 + 65).cast("int")), F.lit("cd.")).alias("text"))
    return T.extract_relations(n).select("doc_id", "relation", "source", "target")


# ---- scalar functions by group ----------------------------------------------------------------------------
def _by_name(spark: SparkSession, rows: dict) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("f"), v.alias("v")) for k, v in rows.items()))))


@query("select l_orderkey, l_linenumber, round(sin(l_tax), 9) as sin, round(cos(l_tax), 9) as cos, round(tan(l_tax), 9) as tan, round(asin(l_tax), 9) as asin, round(acos(l_tax), 9) as acos, round(atan(l_tax), 9) as atan, round(atan2(l_tax, l_discount + 1), 9) as atan2, round(ln(l_quantity), 9) as log, round(log10(l_quantity), 9) as log10, round(exp(l_tax), 9) as exp, round(sqrt(l_quantity), 9) as sqrt, round(pi(), 9) as pi, round(exp(1), 9) as e, sign(l_tax - 0.04)::int as sign, ceil(l_extendedprice)::bigint as ceil, floor(l_extendedprice)::bigint as floor from lineitem")
def math_functions(spark, d):
    a, b, q = F.col("l_tax"), F.col("l_discount") + 1, F.col("l_quantity")
    out = {n: R.call(n, a) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "exp")} | {"atan2": R.call("atan2", a, b), "log": R.call("log", q), "log10": R.call("log10", q), "sqrt": R.call("sqrt", q), "pi": R.call("pi"), "e": R.call("e")}
    whole = {"sign": R.call("sign", a - 0.04).cast("int"), "ceil": R.call("ceil", F.col("l_extendedprice")).cast("long"), "floor": R.call("floor", F.col("l_extendedprice")).cast("long")}
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(n) for n, c in out.items()), *(c.alias(n) for n, c in whole.items()))


@query("select p_partkey, lower(p_name) as lower, upper(p_name) as upper, length(p_name)::int as size, left(p_name, 3) as \"left\", right(p_name, 3) as \"right\", replace(p_name, 'a', 'b') as replace, string_split(p_name, ' ') as split, contains(p_name, 'a') as contains, reverse(p_name) as reverse, coalesce(nullif(p_brand, 'Brand#1'), 'none') as coalesce, substr(p_name, 3, 4) as sub, p_size::varchar as text, (p_size::varchar || '.7')::double::bigint as whole from part")
def string_functions(spark, d):
    p = F.col("p_name")
    rows = {"lower": R.call("toLower", p), "upper": R.call("toUpper", p), "size": R.size(p, "string"), "left": R.call("left", p, F.lit(3)), "right": R.call("right", p, F.lit(3)), "replace": R.call("replace", p, F.lit("a"), F.lit("b")), "split": R.call("split", p, F.lit(" ")), "contains": R.call("contains", p, F.lit("a")), "reverse": R.call("reverse", p), "coalesce": R.call("coalesce", F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.lit("none")), "sub": R.call("substring", p, F.lit(2), F.lit(4)), "text": R.call("toString", F.col("p_size")), "whole": F.floor(F.concat(F.col("p_size").cast("string"), F.lit(".7")).cast("double"))}
    return t(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in rows.items())).withColumn("whole", F.col("whole") + F.when(F.lit(True), 1))


@query("select o_orderkey, (o_orderkey || '.50')::decimal(38, 18)::double as price, null::double as bad, strftime(o_orderdate, '%Y-%m-%d') as day, epoch(o_orderdate)::bigint + 86400 > epoch(timestamp '1995-01-01')::bigint as live from orders")
def exact_values(spark, d):
    o = t(spark, d, "orders")
    when = lineage.iso_time(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return o.select("o_orderkey", T.exact_decimal(F.concat(F.col("o_orderkey").cast("string"), F.lit(".50"))).cast("double").alias("price"), T.exact_decimal(F.lit("1e5")).cast("double").alias("bad"), F.date_format(when, "yyyy-MM-dd").alias("day"), lineage.live(F.col("o_orderdate"), F.lit(86400), F.timestamp_seconds(F.lit(788918400))).alias("live"))


@query("select event_id, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' as canonical, event_type as x_kind, '[' || event_id || ',' || user_id || ']' as x_list from events")
def flattened_records(spark, d):
    e = t(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.array("event_id", "user_id").alias("list")).alias("x"), F.col("event_id").alias("a"), F.col("event_type").alias("b"))
    return io.flatten(e.withColumn("canonical", io.canonical_json("b", "a"))).select("event_id", "canonical", "x_kind", "x_list")


# ---- sources and sinks: what is written is read again ----------------------------------------------------
_SUPPLIERS = "select s_suppkey, s_name, s_acctbal from supplier"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")


@query(_SUPPLIERS)
def roundtrip_json(spark, d):
    path = folder(spark, "json")
    io.save(_suppliers(spark, d), path, "json")
    return io.load(spark, path, "jsonl", schema="s_suppkey bigint, s_name string, s_acctbal double")


@query(_SUPPLIERS)
def roundtrip_csv(spark, d):
    path = folder(spark, "csv")
    io.save(_suppliers(spark, d), path, "csv", sep=";")
    return io.load(spark, path, "csv", sep=";", schema="s_acctbal double, s_name string, s_suppkey bigint", inferSchema="false")


@query(_SUPPLIERS)
def roundtrip_parquet_gzip(spark, d):
    path = folder(spark, "parquet")
    io.save(_suppliers(spark, d), path, "parquet", compression="gzip")
    return io.load(spark, path, "parquet", columns=["s_suppkey", "s_name", "s_acctbal", "absent"])


@query("select s_suppkey, '{\"name\":\"' || s_name || '\"}' as props, '[' || s_nationkey || ']' as nations from supplier")
def write_parquet_nested(spark, d):
    path = folder(spark, "nested")
    s = t(spark, d, "supplier")
    io.write_parquet(s.select("s_suppkey", F.create_map(F.lit("name"), F.col("s_name")).alias("props"), F.array("s_nationkey").alias("nations")), path)
    return io.load(spark, path, "parquet")


@query(_SUPPLIERS)
def convert_formats(spark, d):
    a, b = folder(spark, "from") + ".parquet", folder(spark, "to") + ".jsonl"
    io.save(_suppliers(spark, d), a, "parquet")
    io.convert(spark, a, b)
    return io.load(spark, b, schema="s_suppkey bigint, s_name string, s_acctbal double")


@query("select sum(1)::bigint as records, count(distinct s_nationkey % 3) as files from supplier")
def manifest_records(spark, d):
    path = folder(spark, "lines")
    s = t(spark, d, "supplier")
    s.select(F.to_json(F.struct("s_suppkey")).alias("value"), (F.col("s_nationkey") % 3).alias("k")).repartition(1).write.partitionBy("k").text(path)
    return io.manifest(spark, f"{path}/*/*").agg(F.sum("records").alias("records"), F.count("*").alias("files"))


@query("select s_suppkey, shard from (select s_suppkey, (('0x' || substr(sha256(s_suppkey::varchar), 1, 16))::ubigint % 4)::int as shard from supplier)")
def sharded_write(spark, d):
    path = folder(spark, "shards")
    io.write_shards(t(spark, d, "supplier").select("s_suppkey"), path, "s_suppkey", 4)
    return spark.read.parquet(path).select("s_suppkey", "shard")


@query(f"with {_ALL_EDGES} select '<urn:x:' || src || '> <urn:x:' || type || '> <urn:x:' || dst || '> .' as line from e where type = 'BASED_IN'")
def ntriples_lines(spark, d):
    return io.ntriples(g(spark, d).edges.filter("type = 'BASED_IN'"))


@query("select vec_id % 100 as cid, arg_min(embedding[1], vec_id)::double as x from embeddings group by 1")
def first_vectors(spark, d):
    v = t(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("cid"), "embedding", F.col("vec_id").alias("text_chunk_order"))
    empty = v.withColumns({"embedding": F.array().cast("array<float>"), "text_chunk_order": F.lit(-1).cast("long")})
    return io.first_vector(v.union(empty)).select("cid", F.col("embedding")[0].cast("double").alias("x"))


@query("select n_nationkey, n_name, (select arg_min(embedding[1], vec_id)::double from embeddings where vec_id % 20 = n_nationkey) as x from nation")
def attached_vectors(spark, d):
    v = t(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("cid"), "embedding", F.col("vec_id").alias("text_chunk_order"))
    return io.attach_vectors(t(spark, d, "nation").withColumn("cid", F.col("n_nationkey")), v).select("n_nationkey", "n_name", F.col("embedding")[0].cast("double").alias("x"))


@query("select s_suppkey::varchar as s_suppkey, s_name from supplier where s_suppkey % 3 > 0")
def rebuilt_keys(spark, d):
    s = t(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey").cast("string")).otherwise(" ").alias("s_suppkey"), "s_name")
    return io.rebuild(s, "s_suppkey")


# ---- retrieval ---------------------------------------------------------------------------------------------
@query(f"select vec_id as id, round(1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), 6) as distance from embeddings where label = 1 order by 1 - list_cosine_similarity(embedding::double[], {_QUERY_SQL}), vec_id limit 10")
def vector_metadata(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    return retrieval.vector_topk(v, _QUERY, 10, metadata={"label": "1"}).withColumn("distance", F.round("distance", 6))


@query("select count(*) as n, 64 as dimension, min(len(embedding))::int as least, max(len(embedding))::int as greatest from embeddings")
def store_stats(spark, d):
    return retrieval.store_stats(_vectors(spark, d))


@query("select vec_id as id, i::int as shard, [x::double for x in embedding[i * 22 + 1:i * 22 + 22]] as vec from embeddings, range(3) r(i)")
def split_dimensions(spark, d):
    out = retrieval.split_dimensions(_vectors(spark, d), 3, 64)
    return out.withColumn("vec", F.transform("vec", lambda x: x.cast("double")))


@query("select vec_id as id, case when vec_id % 2 = 0 then 'new' else 'old' end as state from embeddings where vec_id % 3 > 0")
def upsert_delete(spark, d):
    old = _vectors(spark, d).select("id", F.lit("old").alias("state"), F.create_map(F.lit("k"), (F.col("id") % 3).cast("string")).alias("metadata"))
    new = old.filter("id % 2 = 0").withColumn("state", F.lit("new"))
    return retrieval.delete(retrieval.upsert(old, new), metadata={"k": "0"}).select("id", "state")


_TFIDF = "w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents), tf as (select doc_id, term, count(*) as tf from w group by 1, 2), df as (select term, count(*) as df from tf group by 1)"


@query(f"with {_TFIDF}, v as (select doc_id, term, tf * ln(1 + ((select count(*) from documents) - df + 0.5) / (df + 0.5)) as x from tf join df using (term)), b as (select * from v qualify row_number() over (partition by doc_id order by round(x, 9) desc, term) <= 5) select doc_id, term, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from b")
def tfidf_terms(spark, d):
    out = retrieval.term_weights(t(spark, d, "documents"), "tfidf", 5)
    return out.select("doc_id", F.explode("terms").alias("x")).select("doc_id", F.col("x.term").alias("term"), F.round("x.weight", 6).alias("weight"))


@query(f"with {_TFIDF}, dl as (select doc_id, sum(tf)::double as dl from tf group by 1), tot as (select count(*)::double as n, avg(dl) as mean from dl), s as (select q.doc_id as src, tf.doc_id as dst, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score from tf q join tf using (term) join df using (term) join dl on dl.doc_id = tf.doc_id, tot where q.doc_id % 20 = 0 and q.doc_id <> tf.doc_id group by 1, 2) select src, dst, round(score, 5) as score, row_number() over (partition by src order by round(score, 9) desc, dst) as rank from s qualify rank <= 3")
def bm25_neighbours(spark, d):
    docs = t(spark, d, "documents")
    return retrieval.bm25_neighbours(docs, docs.filter("doc_id % 20 = 0"), 3).withColumn("score", F.round("score", 5))


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) select (select count(*) from w where len(w) > 0) as n_docs, (select count(distinct x) from (select unnest(w) as x from w)) as n_terms, (select count(*) from (select distinct doc_id, unnest(w) as x from w)) as n_postings")
def persisted_index(spark, d):
    sizes, terms, tf = (write_table(x, "index") for x in retrieval.postings(t(spark, d, "documents").select("doc_id", "text")))
    return sizes.agg(F.count("*").alias("n_docs")).crossJoin(terms.agg(F.count("*").alias("n_terms"))).crossJoin(tf.agg(F.count("*").alias("n_postings")))


@query("select count(*) as n_docs, round(avg(1 - len(t) / 1000.0), 6) as mean_sparsity, (select count(distinct x) from (select unnest(regexp_extract_all(text, '[0-9]+')) as x from documents)) as n_terms from (select list_distinct(regexp_extract_all(text, '[0-9]+')) as t from documents)")
def sparse_stats(spark, d):
    items = t(spark, d, "documents").select(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("indices"))
    return retrieval.sparse_stats(items, 1000).withColumn("mean_sparsity", F.round("mean_sparsity", 6))


@query("select 10 as queries, true as recalled")
def ann_recall(spark, d):
    """Of ten queries (items with a little of another added), whether the mean recall of the ten nearest is 0.9 or more."""
    items = write_table(_vectors(spark, d), "ann-items")
    index = retrieval.RandomPlanes(items, 64)
    rows = [r["vec"] for r in items.filter("id % 50 = 0").orderBy("id").limit(10).collect()]
    rows += [rows[-1]] * (10 - len(rows))
    recall = 0.0
    for i, v in enumerate(rows):
        q = [a + 0.2 * b for a, b in zip(v, rows[i - 1], strict=True)]
        want = {r["id"] for r in retrieval.vector_topk(items, q, 10).collect()}
        recall += len(want & {r["id"] for r in index.search(q, 10).collect()}) / len(want)
    return spark.createDataFrame([(len(rows), recall / len(rows) >= 0.9)], "queries int, recalled boolean")


# ---- lineage ---------------------------------------------------------------------------------------------------
@query("select a.n_nationkey as id, round(0.5 + 0.5 * (case when a.n_regionkey = b.n_regionkey then 1 else 0 end) / (case when a.n_regionkey = b.n_regionkey then 1 else 1 end), 6) as score from nation a, nation b where b.n_nationkey = 3 and a.n_nationkey <> 3 and a.n_regionkey = b.n_regionkey")
def lineage_similar(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("id"), F.lit("nation").alias("node_type"), F.create_map(F.lit("region"), F.col("n_regionkey").cast("string")).alias("metadata"))
    return lineage.find_similar(n, "3", 0.6).select(F.col("id").cast("bigint").alias("id"), F.round("score", 6).alias("score"))


@query("select o_orderkey, case when o_orderkey % 3 > 0 then 'organization' when o_orderkey % 2 = 1 then 'format' end as boundary, case when o_orderkey % 3 > 0 then 'high' when o_orderkey % 2 = 1 then 'low' end as risk from orders")
def lineage_boundaries(spark, d):
    k = F.col("o_orderkey")
    a = F.create_map(F.lit("organization"), F.lit("0"), F.lit("format"), F.lit("0"))
    b = F.create_map(F.lit("organization"), (k % 3).cast("string"), F.lit("format"), (k % 2).cast("string"))
    out = t(spark, d, "orders").select("o_orderkey", lineage.boundary(a, b).alias("boundary"))
    return out.withColumn("risk", lineage.boundary_risk(F.col("boundary")))


@query("select o_orderkey, case when year(o_orderdate) <> 1995 then 'the year and date' end as wrong from orders")
def citation_checks(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.lit("x").alias("cid"), F.lit("Seattle, Wash., Code § 3 (1995)").alias("citation"), F.col("o_orderdate").cast("date").alias("date"), F.lit("municipal").alias("code_type"), F.lit("C1").alias("class_code"))
    out = lineage.citation_errors(rows)
    return out.select("o_orderkey", F.when(F.col("date_error").isNotNull(), "the year and date").alias("wrong"))
