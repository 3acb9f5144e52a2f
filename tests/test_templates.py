import pytest
from pyspark.sql import functions as F

from millrace.operators import lineage
from millrace.operators.graph import Graph
from millrace.plans import triples as T
from millrace.sources import io


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([("a", "type", "P"), ("b", "type", "P"), ("a", "knows", "b"), ("b", "knows", "c"), ("a", "city", "X"), ("b", "city", "X")], "s string, p string, o string")


def test_templates(t):
    assert T.entity(t, "a").count() == 3 and T.properties(t, "a", ["city"]).first().o == "X"
    assert T.direct(t, "a", "knows").first().o == "b" and T.inverse(t, "c", "knows").first().s == "b"
    assert [r.s for r in T.of_type(t, "P").collect()] == ["a", "b"] and T.path(t, "a", ["knows", "knows"]).first().o == "c"
    assert tuple(T.similar(t, "a").first()) == ("b", 2) and T.exists(t, "a", "city", "X") and not T.exists(t, "a", "city", "Y")
    assert {r.p: r.subjects for r in T.predicate_counts(t).collect()} == {"type": 2, "knows": 2, "city": 2}


def test_graphql(spark):
    g = Graph(spark.createDataFrame([("1", ["P"], "Al", "LA"), ("2", ["P"], "Bo", "SF")], "id string, labels array<string>, name string, city string"), spark.createDataFrame([("1", "2", "KNOWS")], "src string, dst string, type string"))
    r = T.graphql(g, '{ P(city: "LA", limit: 5) { name KNOWS { name city } } }').collect()
    assert len(r) == 1 and r[0].name == "Al" and r[0].KNOWS[0].name == "Bo" and "id" not in r[0].asDict()
    for bad in ("{", "{ P { name } } x", "{ P { name } Q { name } }", "P"):
        with pytest.raises(ValueError):
            T.graphql(g, bad)


def test_lineage(spark):
    n = spark.createDataFrame([("a", "t", {"x": "1", "y": "2"}), ("b", "t", {"x": "1", "y": "3"}), ("c", "u", {"z": "0"})], "id string, node_type string, metadata map<string,string>")
    assert [(r.id, r.score) for r in lineage.find_similar(n, "a").collect()] == [("b", 0.75)]
    m = lambda **k: F.create_map(*(F.lit(v) for kv in k.items() for v in kv))
    kind = lineage.boundary(m(system="s", format="csv"), m(system="s", format="json"))
    assert tuple(spark.range(1).select(kind, lineage.boundary_risk(kind)).first()) == ("format", "low")
    rows = spark.createDataFrame([("1", "City, St., Code § 1-2 (2001)", "2001-05-01", "municipal", "C1"), ("2", "bad (1500)", None, "municipal", "H1")], "cid string, citation string, date string, code_type string, class_code string")
    good, bad = lineage.citation_errors(rows).orderBy("cid").collect()
    assert good.date_error is None and good.format_error is None and good.code_error is None
    assert bad.date_error and bad.format_error and bad.code_error
    assert lineage.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert lineage.metadata_for(2, [{"k": 1}]) == [{"k": 1}] * 2 and lineage.metadata_for(2, [1, 2, 3]) == [{"vector_index": 0}, {"vector_index": 1}]
    assert lineage.raw_cid(b"").startswith("bafkrei") and len(lineage.raw_cid(b"")) == 59
    x = spark.range(1).select(lineage.iso_time(F.lit("2024-01-02T03:04:05Z")).alias("t"), lineage.hashed_terms(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("h"), io.json_structure(F.lit('{"a": [1, {"b": "{"}]}'))["n_objects"].alias("n")).first()
    assert x.t is not None and sorted(x.h.values()) == [1, 2] and x.n == 2
