import pytest

from millrace.operators.graph import Graph
from millrace.plans.cypher import CypherError, cypher
from millrace.plans.cypher_write import cypher_write


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", ["P"], "Ann", 1), ("b", ["P"], "Bob", 2), ("c", ["Q"], None, 3)], "id string, labels array<string>, name string, age int")
    edges = spark.createDataFrame([("a", "b", "KNOWS")], "src string, dst string, type string")
    return Graph(nodes, edges)


def nodes(g, *columns):
    return sorted(map(tuple, g.nodes.select("id", *columns).collect()), key=str)


def test_each_clause(graph):
    g = cypher_write(graph, "CREATE (d:P {id: 'd', name: 'Dan'})-[:KNOWS]->(e:Q {id: 'e'})")
    assert nodes(g, "name") == [("a", "Ann"), ("b", "Bob"), ("c", None), ("d", "Dan"), ("e", None)]
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b", "KNOWS"), ("d", "e", "KNOWS")]
    g = cypher_write(graph, "MATCH (n:P) WHERE n.age > 1 SET n.name = toUpper(n.name), n:Old")
    assert nodes(g, "name", "labels") == [("a", "Ann", ["P"]), ("b", "BOB", ["P", "Old"]), ("c", None, ["Q"])]
    g = cypher_write(graph, "MATCH (n:P) REMOVE n.age, n:P")
    assert nodes(g, "age", "labels") == [("a", None, []), ("b", None, []), ("c", 3, ["Q"])]
    g = cypher_write(graph, "MATCH (a:P)-[r:KNOWS]->(b:P) DELETE r")
    assert g.edges.count() == 0 and g.nodes.count() == 3
    assert cypher_write(graph, "MATCH (n:P) DETACH DELETE n").nodes.count() == 1


def test_merge(graph):
    g = cypher_write(graph, "MERGE (n:P {id: 'a'}) ON CREATE SET n.age = 100 ON MATCH SET n.age = 50")
    assert nodes(g, "age") == [("a", 50), ("b", 2), ("c", 3)]
    g = cypher_write(graph, "MERGE (n:P {id: $i}) ON CREATE SET n.age = 100 ON MATCH SET n.age = 50", {"i": "z"})
    assert nodes(g, "age")[-1] == ("z", 100)
    g = cypher_write(graph, "MATCH (a:P), (c:Q) MERGE (a)-[:LIKES]->(c)")
    assert g.edges.count() == 3 and cypher_write(g, "MATCH (a:P), (c:Q) MERGE (a)-[:LIKES]->(c)").edges.count() == 3


@pytest.mark.parametrize("q", ["CREATE (n:P {id: 'a'})", "CREATE (n:P {name: 'x'})", "MATCH (n:P) SET n.id = 'x'", "MATCH (n) RETURN n", "MATCH (a:P), (b:P) CREATE (a)-[:X]-(b)"])
def test_what_cannot_be_written(graph, q):
    with pytest.raises(CypherError):
        cypher_write(graph, q)


def test_nodes_with_edges_need_detach(graph):
    with pytest.raises(ValueError, match="detach"):
        cypher_write(graph, "MATCH (n:P) DELETE n")


def test_variable_length_walks_an_edge_once(graph):
    got = sorted(map(tuple, cypher(graph, "MATCH (x)-[:KNOWS*1..3]-(y) RETURN x.id AS x, y.id AS y").collect()))
    assert got == [("a", "b"), ("b", "a")]
