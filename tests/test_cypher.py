import pytest

from millrace.operators.graph import Graph
from millrace.plans.cypher import CypherError, cypher

PEOPLE = [("1", ["Person"], "Alice", 30, "NYC"), ("2", ["Person"], "Bob", 25, "LA"), ("3", ["Person"], "Charlie", 35, "NYC"), ("4", ["Person"], "David", 28, "SF"), ("5", ["Person", "Guest"], "Eve", None, "Boston")]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(PEOPLE, "id string, labels array<string>, name string, age int, city string")
    edges = spark.createDataFrame([("1", "2", "KNOWS", 2010), ("2", "3", "KNOWS", 2015), ("1", "3", "LIKES", 2020)], "src string, dst string, type string, since int")
    return Graph(nodes, edges)


def rows(g, q, **p):
    return [tuple(r) for r in cypher(g, q, p).collect()]


@pytest.mark.parametrize(
    "query, want",
    [
        ("MATCH (n:Person) RETURN n.age ORDER BY n.age", [(25,), (28,), (30,), (35,), (None,)]),
        ("MATCH (n:Person) RETURN n.age ORDER BY n.age DESC", [(35,), (30,), (28,), (25,), (None,)]),
        ("MATCH (n:Person) RETURN n.age ORDER BY n.age SKIP 1 LIMIT 2", [(28,), (30,)]),
        ("MATCH (n:Person) WHERE n.age > 26 RETURN n.city AS city, COUNT(n) AS k ORDER BY k DESC, city", [("NYC", 2), ("SF", 1)]),
        ("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.name, b.name ORDER BY b.age", [("Alice", "Bob"), ("Bob", "Charlie")]),
        ("MATCH (a)<-[:KNOWS]-(b) RETURN a.name AS n ORDER BY n", [("Bob",), ("Charlie",)]),
        ("MATCH (a {name: 'Bob'})-[r:KNOWS]-(b) RETURN b.name, type(r), r.since ORDER BY b.name", [("Alice", "KNOWS", 2010), ("Charlie", "KNOWS", 2015)]),
        ("MATCH (a)-[:KNOWS*1..2]->(b) WHERE a.name = 'Alice' RETURN b.name ORDER BY b.name", [("Bob",), ("Charlie",)]),
        ("MATCH (a)-[:KNOWS]->(b), (a)-[:LIKES]->(c) RETURN a.name, b.name, c.name", [("Alice", "Bob", "Charlie")]),
        ("MATCH (n:Person) WHERE n.name CONTAINS 'li' AND NOT n.age IS NULL RETURN n.name ORDER BY n.name", [("Alice",), ("Charlie",)]),
        ("MATCH (n) WHERE n.name STARTS WITH 'D' OR n.name ENDS WITH 'e' RETURN count(*) AS c", [(4,)]),
        ("MATCH (n) WHERE n.city IN ['LA', 'SF'] RETURN n.name ORDER BY n.name", [("Bob",), ("David",)]),
        ("MATCH (n) WHERE n.name = $who RETURN CASE WHEN n.age > 28 THEN 'old' ELSE 'young' END AS a", [("old",)]),
        ("MATCH (n) RETURN DISTINCT n.city AS c ORDER BY c LIMIT 2", [("Boston",), ("LA",)]),
        ("MATCH (n) RETURN sum(n.age) AS s, avg(n.age) AS a, min(n.age) AS lo, max(n.age) AS hi, count(n.age) AS c", [(118, 29.5, 25, 35, 4)]),
        ("MATCH (n:Guest) RETURN nope(n.age) AS x, labels(n) AS l, id(n) AS i, n.missing AS m", [(None, ["Person", "Guest"], "5", None)]),
        ("MATCH (n {name: 'Bob'}) RETURN toLower(n.name) AS a, substring(n.name, 1, 2) AS b, size(n.name) AS c, 1 + 2 * 3 AS d", [("bob", "ob", 3, 7)]),
        ("MATCH (n {name: 'Eve'}) OPTIONAL MATCH (n)-[:KNOWS]->(m) RETURN n.name, m.name", [("Eve", None)]),
        ("MATCH (n) WITH n.city AS city, count(*) AS k WHERE k > 1 RETURN city, k", [("NYC", 2)]),
        ("UNWIND [3, 1, 2] AS x RETURN x ORDER BY x", [(1,), (2,), (3,)]),
        ("RETURN 1 AS x", []),
        ("MATCH (n {name: 'test@example.com'}) RETURN n.name", []),
        ("MATCH (a)-[]->(b)<-[]-(c) RETURN a.name, c.name ORDER BY a.name", [("Alice", "Bob"), ("Bob", "Alice")]),
        ("MATCH (n) WHERE n.name =~ 'A.*' RETURN n.name", [("Alice",)]),
    ],
)
def test_queries(g, query, want):
    assert rows(g, query, who="Alice") == want


def test_names_and_union(g):
    assert cypher(g, "MATCH (n) RETURN n.age").columns == ["n.age"]
    q = "MATCH (n:Person) RETURN n.city UNION {} MATCH (m:Person) RETURN m.city"
    assert len(rows(g, q.format("ALL"))) == 10 and len(rows(g, q.format(""))) == 4
    three = "MATCH (n {name: 'Bob'}) RETURN n.age UNION MATCH (n {name: 'Bob'}) RETURN n.age UNION MATCH (n {name: 'Alice'}) RETURN n.age"
    assert sorted(rows(g, three)) == [(25,), (30,)]


@pytest.mark.parametrize("bad", ["", "MATCH (n", "MATCH (n) RETURN x", "MATCH (n)-[*]->(m) RETURN n", "FOO", "MATCH (n) RETURN n.a UNION MATCH (n) RETURN n.a, n.b", "MATCH (n) RETURN $p"])
def test_errors(g, bad):
    with pytest.raises(CypherError):
        cypher(g, bad)


def test_filters_reach_the_scan(spark, tmp_path, g):
    g.nodes.write.parquet(str(tmp_path / "n"))
    on_disk = Graph(spark.read.parquet(str(tmp_path / "n")), g.edges)
    plan = cypher(on_disk, "MATCH (n:Person) WHERE n.age > 26 RETURN n.name")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(age), GreaterThan(age,26)]" in plan and "city" not in plan.split("ReadSchema")[1]
