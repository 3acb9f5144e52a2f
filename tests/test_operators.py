import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import etl, quality, retrieval, stats
from millrace.operators.components import connected_components
from millrace.operators.graph import Graph, beam, resolve_entities
from millrace.plans import ir, pipeline
from millrace.sources import io
from millrace.streaming import metrics


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(x, ["N"], x.lower()) for x in "ABCDE"], "id string, labels array<string>, name string")
    edges = spark.createDataFrame([("A", "B", "r"), ("B", "C", "r"), ("A", "C", "s"), ("C", "C", "r")], "src string, dst string, type string")
    return Graph(nodes, edges)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(None, 3), (5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_traversal(g):
    a = g.seeds(["A"])
    assert {r.id: r.depth for r in g.traverse(a, 5, ["r"]).collect()} == {"A": 0, "B": 1, "C": 2}
    assert ids(g.traverse(a, 5, max_nodes=2)) == ["A", "B"]
    f = g.focus("B", 1)
    assert ids(f.nodes) == ["A", "B", "C"] and f.edges.count() == 4
    assert sorted("".join(r.path) for r in g.paths(a, 3).collect()) == ["AB", "ABC", "AC"]
    reached, used = g.closure(a, ["r"])
    assert reached.count() == 3 and used.count() == 3
    assert ids(g.roots()) == ["A", "D", "E"] and ids(g.leaves()) == ["D", "E"]
    assert {(r.direction, r.id) for r in g.impact(g.seeds(["B"])).collect()} == {("downstream", "C"), ("upstream", "A")}
    m = g.metrics().first()
    assert (m.n_nodes, m.n_edges, m.n_components, m.max_degree) == (5, 4, 3, 4)
    big = g.communities().orderBy(F.desc("size")).first()
    assert (big.size, big.n_edges, round(big.cohesion, 3)) == (3, 4, 4.0)


def test_derived_edges_and_changes(spark, g):
    square = Graph(g.nodes, spark.createDataFrame([("A", "C", "r"), ("B", "C", "r"), ("A", "D", "r"), ("B", "D", "r")], "src string, dst string, type string"))
    got = {(r.src, r.dst) for r in square.suggest(0.3).collect()}
    assert got == {("A", "B"), ("C", "D")}
    onto = Graph(g.nodes, spark.createDataFrame([("x", "Dog", "type"), ("Dog", "Mammal", "subClassOf"), ("Mammal", "Animal", "subClassOf"), ("a", "b", "near"), ("p", "q", "owns"), ("owns", "has", "subPropertyOf")], "src string, dst string, type string"))
    made = {(r.src, r.dst, r.type) for r in onto.materialise(symmetric=("near",), inverse={"owns": "ownedBy"}).collect()}
    assert {("x", "Animal", "type"), ("b", "a", "near"), ("q", "p", "ownedBy"), ("p", "q", "has")} <= made
    with pytest.raises(ValueError):
        g.delete_nodes(g.seeds(["A"]))
    h = g.delete_nodes(g.seeds(["A"]), detach=True)
    assert h.nodes.count() == 4 and h.edges.count() == 2
    n = g.merge_nodes(spark.createDataFrame([("A", ["N"], "new"), ("Z", ["N"], "z")], g.nodes.schema), {"name": F.lit("hit")})
    assert {r.id: r.name for r in n.nodes.collect()} == {"A": "hit", "B": "b", "C": "c", "D": "d", "E": "e", "Z": "z"}
    assert g.set_property(F.col("id") == "A", age=F.lit(3)).nodes.filter("age = 3").count() == 1
    assert g.remove_label(F.col("id") == "A", "N").scan("N").count() == 4
    vec = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", [1.0, 1.0])], "id string, vec array<double>")
    assert beam(g, g.seeds(["A"]), vec, [0.0, 1.0], 1, 1).filter("hop = 1").first().id == "B"
    assert g.propagate(vec).filter("id = 'A'").first().vec == [0.75, 0.5]
    names = spark.createDataFrame([("1", "Microsoft"), ("2", "microsoft "), ("3", "Apple")], "id string, name string")
    assert {r.id: r.canonical for r in resolve_entities(names).collect()} == {"1": "1", "2": "1", "3": "3"}


def test_ir_budgets(g):
    q = ir.QueryIR.from_ops([ir.SeedEntities(("A",)), ir.Expand(), ir.Expand(), ir.Project(("id",))])
    assert ids(ir.execute(g, q, ir.preset("safe"))) == ["C"]
    with pytest.raises(ir.BudgetExceeded):
        ir.execute(g, q, ir.preset(max_depth=1))
    with pytest.raises(ir.BudgetExceeded):
        ir.execute(g, ir.QueryIR().add(ir.ScanType("N")), ir.preset(max_working_set=2))
    for bad in ("moderate", "x"):
        with pytest.raises(ValueError):
            ir.preset(bad)
    assert ids(ir.page(g.nodes, "id", 1, 2)) == ["C", "D"]


def test_retrieval(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], {"k": "a"}), (2, [0.0, 1.0], {"k": "b"}), (3, [1.0, 1.0], {"k": "a"}), (4, [0.0, 0.0], {})], "id int, vec array<double>, metadata map<string,string>")
    assert [r.id for r in retrieval.vector_topk(items, [1.0, 0.1], 2).collect()] == [1, 3]
    assert [r.id for r in retrieval.vector_topk(items, [0.0, 1.0], 5, "l2", {"k": "a"}).collect()] == [3, 1]
    assert [r.id for r in retrieval.vector_topk(items, [1.0, 1.0], 1, "ip").collect()] == [3]
    with pytest.raises(Exception, match="DIM"):
        retrieval.vector_topk(items, [1.0], 1).collect()
    index = retrieval.RandomPlanes(items, 2)
    assert [r.id for r in index.search([1.0, 0.1], 1).collect()] == [1]
    index.delete(spark.createDataFrame([(1,)], "id int"))
    assert [r.id for r in index.search([1.0, 0.1], 1).collect()] == [3]
    index.healthy = False
    assert 1 not in [r.id for r in index.search([1.0, 0.1], 3).collect()]
    docs = spark.createDataFrame([(1, "law", "extension of time"), (2, "extension", "extension law"), (3, "other", "nothing")], "doc_id int, title string, text string")
    got = retrieval.bm25(docs, "extension").collect()
    assert [r.doc_id for r in got] == [2, 1] and got[0].matched_terms == ["extension"]
    tf = {(r.doc_id, r.term): r.tf for r in retrieval.postings(docs)[2].collect()}
    assert tf[2, "extension"] == 3
    assert retrieval.term_weights(docs, "bm25").count() == 3
    sparse = spark.createDataFrame([(1, [1, 2, 3]), (2, [9]), (3, [1])], "id int, indices array<int>")
    assert [(r.id, round(r.score, 3)) for r in retrieval.sparse_search(sparse, [1, 2]).collect()] == [(1, 0.667), (3, 0.5)]
    v = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, score double")
    lex = spark.createDataFrame([(2, 5.0), (3, 1.0)], "id int, score double")
    assert [r.id for r in retrieval.hybrid(v, lex, 0.6).collect()] == [1, 2, 3]
    engines = spark.createDataFrame([("a", 1, "u", 0.5), ("b", 1, "v", 0.9), ("a", 2, "v", 0.4), ("b", 2, "w", 0.1)], "engine string, rank int, url string, score double")
    assert [r.url for r in retrieval.merge_engines(engines, "round_robin").collect()] == ["u", "v", "w"]
    assert [r.url for r in retrieval.merge_engines(engines, "best").collect()] == ["v", "w"]
    shards = retrieval.ring_assign(spark.range(50), "id", ["a", "b", "c", "d"], 3).collect()
    assert all(len(set(r.shards)) == 3 for r in shards) and len({r.shards[0] for r in shards}) == 4
    assert ids(retrieval.delete(items, metadata={"k": "a"})) == [2, 4] and ids(retrieval.delete(items, [2])) == [1, 3, 4]


def test_stats(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 12)], "k string, v double")
    agg = df.agg(stats.percentile_nearest(F.col("v"), 0.95).alias("n"), stats.percentile_lower(F.col("v"), 0.95).alias("l")).first()
    assert (agg.n, agg.l) == (11.0, 10.0)
    assert stats.exact_percentile(df, ["k"], "v", 0.95).first().percentile == 11.0
    assert df.limit(0).agg(stats.percentile_lower(F.col("v"), 0.5).alias("x")).first().x == 0.5
    calls = spark.createDataFrame([("u", i) for i in (0, 1, 2, 10, 11, 12)], "u string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.allowed for r in stats.rate_limit(calls, "u", "ts", 2, 10).orderBy("ts").collect()]
    assert got == [True, True, False, True, True, False]
    assert spark.range(1).select(stats.map_delta(F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(3))).alias("m")).first().m == {"a": 2, "b": None}
    log = spark.createDataFrame([(0, "p", 1.0, True), (1000, "p", 3.0, False)], "s long, pattern string, seconds double, hit boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert (stats.query_stats(log).first().recent_avg, stats.query_stats(log).first().hit_rate) == (3.0, 0.5)


def test_quality(spark):
    e = spark.createDataFrame([("o", "a", "person", "Ann", {"x": "1"}, 0.9), ("o", "b", "organization", "Bx", {}, None), ("o", "b", "location", "Cyd", {}, 0.0)], "ontology_id string, id string, type string, text string, properties map<string,string>, confidence double")
    r = spark.createDataFrame([("o", "a", "b", "manages_x"), ("o", "b", "a", "part_of"), ("o", "a", "b", "is_a"), ("o", "a", "zz", "related_to")], "ontology_id string, source_id string, target_id string, type string")
    assert quality.critic_completeness(e, r).first().completeness == round(0.3 * 0.3 + 0.3 + 0.2 + 0.2, 4)
    src = spark.createDataFrame([("o", "ann and cyd")], "ontology_id string, source string")
    assert quality.critic_completeness(e, r, src).first().completeness == round(0.25 * 0.3 + 0.25 + 0.15 + 0.15 + 0.2 * 2 / 3, 4)
    assert quality.critic_consistency(e, r).first().consistency == round(0.5 * (1 - 1 / 8) + 0.3 * (1 - 1 / 3) + 0.2 * 0.85, 4)
    assert quality.cyclic(r).count() == 1 and quality.cyclic(r.filter("type = 'is_a'")).count() == 0
    assert 0 < quality.critic_coherence(e, r).first().coherence <= 1
    assert quality.critic_coherence(e, r.limit(0)).first().coherence == 0.3
    assert quality.critic_clarity(e).first().clarity == round(0.3 / 3 + 0.2 * 3 / 3 + 0.2 + 0.2 / 3 - 0.1 / 3, 4)
    assert quality.critic_granularity(e, r).first().granularity == round(0.45 / 9 + 0.4 * min(4 / 3 / 1.5, 1) - 0.2, 4)
    assert quality.critic_alignment(e, r).first().alignment == round(3 / 7, 4)
    assert quality.schema_compatibility(3, 101, 0) == {"score": 85, "compatible": True, "warnings": ["many labels"]}
    logs = spark.createDataFrame([(1, "timeout here"), (2, "timeout, denied"), (3, "fine")], "id int, line string")
    assert [(p.pattern, p.n, p.percent) for p in quality.error_patterns(logs, {"t": "timeout", "d": "denied"}).collect()] == [("t", 2, 66.67)]
    trend = spark.createDataFrame([("k", 1, 0.1), ("k", 2, 0.9)], "k string, n int, v double")
    assert quality.trend(trend, "k", "n", "v").first().trend == "improving"
    assert [r.rank for r in quality.rank_by(spark.createDataFrame([("a", 0.1), ("b", 0.9)], "ontology_id string, overall double")).orderBy("ontology_id").collect()] == [2, 1]


def test_etl(spark):
    f = spark.createDataFrame([("index.html", "x"), ("b.html", "x"), ("cc.html", "y"), ("d.html", "y")], "name string, body string")
    assert ids(etl.exact_dedup(f, "body", "name", F.col("name") == "index.html"), "name") == ["d.html", "index.html"]
    m = spark.createDataFrame([("Ann", "e1", 1, 1.0), ("Ann", "e1", 2, 0.0), ("Ann", "e2", 2, 1.0)], "name string, entity_id string, doc_id int, confidence double")
    assert tuple(etl.merge_mentions(m).select("n_mentions", "confidence", "n_docs").first()) == (3, 0.75, 2)
    near = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 50.0, 0.0), (4, 89.9, 0.0), (5, 89.9, 180.0)], "id int, lat double, lon double")
    assert {(r.a_id, r.b_id) for r in etl.within_radius(near, near, 60.0).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (1, 2), (2, 1), (4, 5), (5, 4)}
    emails = spark.createDataFrame([("a@x", "b@x", "Hi", "2024", "body one", None, [(3,)]), ("b@x", "a@x", "Re", "2025", "body", "m1", []), ("c@x", "a@x", "Re", "2025", "bo", "m1", [])], "from string, to string, subject string, date string, body_text string, in_reply_to string, attachments array<struct<size:int>>")
    r = etl.email_analytics(emails).first()
    assert (r.n, r.n_attachments, r.attachment_bytes, r.avg_body, r.n_threads, r.n_long_threads) == (3, 1, 3, 4, 1, 1)
    assert etl.email_search(emails, "BODY", "body").count() == 2
    red = spark.range(1).select(etl.redact(F.create_map(F.lit("api_token"), F.lit("x"), F.lit("name"), F.lit("n" * 200))).alias("m")).first().m
    assert red["api_token"] == "[REDACTED]" and len(red["name"]) == 128


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", (2, [1, 2]), {"k": "v"}), (2, "b", (3, []), {})], "id int, s string, n struct<x:int,y:array<int>>, m map<string,string>")
    assert io.flatten(df).columns == ["id", "s", "n_x", "n_y", "m"]
    for name in ("a.jsonl", "b.parquet", "c.csv"):
        p = str(tmp_path / name)
        io.save(df, p)
        assert io.load(spark, p).count() == 2
    assert io.load(spark, str(tmp_path / "c.csv")).columns == ["id", "m", "n_x", "n_y", "s"]
    io.write_parquet(df, str(tmp_path / "z.parquet"))
    assert io.load(spark, str(tmp_path / "z.parquet"), columns=["m", "nope"], max_rows=5).filter("m is null").count() == 1
    assert io.convert(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "k.parquet")) and not io.convert(spark, "x.csv", "y.csv")
    assert io.convert_many(spark, [(str(tmp_path / "gone.csv"), str(tmp_path / "q.parquet"))])["status"] == "error"
    for bad in ("", " ", "evil.py", "run.exe"):
        with pytest.raises(ValueError):
            io.load(spark, bad)
    (tmp_path / "s.csv").write_text("number;word\n1;x\n2;yy\n3;z\n")
    assert io.csv_dialect(spark, str(tmp_path / "s.csv"))["sep"] == ";" and io.read_csv(spark, str(tmp_path / "s.csv")).columns == ["number", "word"]
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert io.count_lines(spark, str(tmp_path / "l.jsonl")) == 2 and io.jsonl(spark, str(tmp_path / "l.jsonl")).count() == 2
    m = io.manifest(spark, str(tmp_path / "l.jsonl")).first()
    assert (m.bytes, m.records, len(m.sha256)) == (17, 2, 64)
    (tmp_path / "mail.json").write_text('{"emails":[{"subject":"x"},{"subject":"y"}]}')
    assert io.exported(spark, str(tmp_path / "mail.json")).count() == 2
    with pytest.raises(ValueError):
        io.exported(spark, str(tmp_path / "mail.json"), "rows")
    with pytest.raises(ValueError):
        io.page(df, "id", -1)
    assert io.page(df, "id", 0, 0).count() == 0
    io.write_shards(df.select("id", "s"), str(tmp_path / "sh"), "id", 3)
    assert spark.read.parquet(str(tmp_path / "sh")).count() == 2
    vec = spark.createDataFrame([("c", [], 0), ("c", [1.0], 2), ("c", [2.0], 1)], "cid string, embedding array<double>, text_chunk_order int")
    assert io.first_vector(vec).first().embedding == [2.0]
    e = spark.createDataFrame([("a b", "t", "c")], "src string, type string, dst string")
    assert io.ntriples(e).first().line == "<urn:x:a_b> <urn:x:t> <urn:x:c> ."


def test_pipeline_steps(spark):
    df = spark.createDataFrame([(1, " A ", "x"), (3, "b", "y")], "n int, s string, t string")
    out = pipeline.process(df, [{"type": "normalize", "columns": ["n", "s"]}, {"type": "sort", "columns": ["n"], "descending": True}, {"type": "validate_schema", "schema": {"n": "double"}}])
    assert [tuple(r) for r in out.collect()] == [(1.0, "b", "y"), (0.0, "a", "x")]
    for bad in ({"type": "nope"}, {"type": "filter"}, {"type": "filter", "condition": "eval(1)"}, {"type": "validate_schema", "schema": {"n": "string"}}, 3):
        with pytest.raises(pipeline.StepError):
            pipeline.process(df, [bad])
    done, error = pipeline.Pipeline(("ok", lambda d: d), ("bad", lambda d: d.select("gone"))).run(df)
    assert done is None and error.startswith("bad")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u", i) for i in (1000, 1001, 1002, 1010, 1011, 1400)], "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"), F.col("s").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = metrics.read_events(spark, str(tmp_path / "in"), "u string, ts timestamp, v double")
    got = sorted(tuple(r) for r in metrics.run_once(metrics.windowed(stream, "ts", ["u"], "v"), "w").collect())
    assert got == sorted(tuple(r) for r in metrics.windowed(rows, "ts", ["u"], "v").collect()) and len(got) == 2
    live = metrics.run_once(metrics.limiter(stream, "u", "ts", 2, 10), "l", "append").orderBy("ts").collect()
    assert len(live) == 6, live
    assert [r.allowed for r in live] == [r.allowed for r in stats.rate_limit(rows, "u", "ts", 2, 10).orderBy("ts").collect()]


def test_entities_resolve_as_all_pairs_do(spark):
    import random

    from millrace.operators.graph import resolve_entities

    rnd = random.Random(7)
    names = []
    for _ in range(25):
        base = "".join(rnd.choices("abcdef ", k=rnd.randint(1, 30))).strip() or "a"
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                rnd.choice([lambda w=w: w.insert(rnd.randrange(len(w) + 1), "x"), lambda w=w: w and w.pop(rnd.randrange(len(w))), lambda w=w: w and w.__setitem__(rnd.randrange(len(w)), "y")])()
            names.append("".join(w).strip() or "b")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    up = list(range(len(names)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(names):
        for j in range(i):
            if 1 - distance(a, names[j]) / max(len(a), len(names[j])) >= 0.8 - 1e-9:
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.id: r.canonical for r in resolve_entities(spark.createDataFrame(list(enumerate(names)), "id int, name string"), 0.8).collect()}
    assert got == {i: find(i) for i in range(len(names))} and len(set(got.values())) < len(names)
