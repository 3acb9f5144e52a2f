import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import registry as R
from millrace.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("args, want", [((0, 5), [0, 1, 2, 3, 4]), ((0, 10, 3), [0, 3, 6, 9]), ((5, 0, -2), [5, 3, 1]), ((3, 3), []), ((0, 5, -1), []), ((None, 3), None)])
def test_range(spark, args, want):
    assert one(spark, R.range_(*(F.lit(a) for a in args))) == want


def test_lists(spark):
    a, empty, null = F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>"), F.lit(None).cast("array<int>")
    assert [one(spark, R.head(x)) for x in (a, empty, null)] == [1, None, None]
    assert [one(spark, R.last(x)) for x in (a, empty, null)] == [2, None, None]
    assert [one(spark, R.tail(x)) for x in (a, empty, null)] == [[2], [], None]
    assert [one(spark, R.size(x)) for x in (a, empty, null)] == [2, 0, None]
    assert one(spark, R.size(F.lit("abc"), "string")) == 3 and one(spark, R.call("reverse", F.lit("abc"))) == "cba"


@pytest.mark.parametrize("name, bad, good", [("log", 0.0, 1.0), ("log10", -1.0, 10.0), ("asin", 2.0, 1.0), ("acos", -2.0, 1.0), ("sqrt", -1.0, 4.0)])
def test_domains_raise(spark, name, bad, good):
    with pytest.raises(Exception, match="number"):
        one(spark, R.call(name, F.lit(bad)))
    assert math.isfinite(one(spark, R.call(name, F.lit(good)))) and one(spark, R.call(name, F.lit(None).cast("double"))) is None


def test_unknown_functions(spark):
    assert one(spark, R.call("nope", F.lit(1))) is None
    with pytest.raises(KeyError):
        R.call("nope", strict=True)


def test_texts(spark):
    assert one(spark, T.normalise(F.lit("a\r\n\n\n\nb\t– “c”…  £5"))) == 'a\n\nb - "c"... GBP 5'
    assert one(spark, T.without_phrases(F.lit("x toon relaties in LIDO  y"))) == "x y"
    assert one(spark, T.tokens(F.lit("Ab c-12 é"), 2)) == ["ab", "12"]
    assert one(spark, T.jaccard(F.lit("a B c"), F.lit("b  c d"))) == 0.5 and one(spark, T.jaccard(F.lit(""), F.lit("a"))) == 0
    assert one(spark, T.chunks(F.lit("abcdefghij"), size=4, overlap=1)) == ["abcd", "defg", "ghij"]
    assert one(spark, T.chunks(F.lit("One. Two! Three"), "sentence")) == ["One.", "Two!", "Three"]
    assert one(spark, T.html_text(F.lit("<p>a<script>x</script> b</p>\n<b>c &amp; d</b>"))) == "a b c & d"
    assert one(spark, T.html_headings(F.lit("<h1>A</h1><h2 x>B <i>c</i></h2>"))) == ["A", "B c"]
    assert one(spark, T.domain(F.lit("HTTP://www.Example.com/x"))) == "example.com"
    assert one(spark, T.label_map(F.lit("B-PER"), T.TAGGER_LABELS, True)) == "person"
    assert one(spark, T.first_filled(F.lit(None), F.lit("  "), F.lit(" x "))) == "x"
    assert one(spark, T.compose(F.lit(" a  b"), F.lit(None), F.lit("c"))) == "a b\nc"
    out = T.sanitise(F.lit("a <script>b</script> <iframe src=x></iframe> me@x.org"))
    assert [one(spark, out[k]) for k in ("text", "n_scripts", "n_active", "n_personal")] == ["a   [EMAIL]", 1, 1, 1]
    cites = one(spark, T.history_citations(F.lit("Text. [1995 c.12 §3; 2001 c.4 §7]")))
    assert [tuple(c) for c in cites] == [("1995", "12", "3"), ("2001", "4", "7")]
    assert one(spark, T.structure_similarity(F.lit("a\n\nb"), F.lit("a\n\nb"))) == 1.0
    assert one(spark, T.exact_decimal(F.lit("1e5"), 2)) is None and str(one(spark, T.exact_decimal(F.lit("12.50"), 2))) == "12.50"


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Marie Curie works at Sorbonne University. Dr. Alan Turing studied machine learning in Cambridge.")], "doc_id int, text string")
    got = {(r.name, r.entity_type) for r in T.extract_entities(docs).collect()}
    assert {("Marie Curie", "person"), ("machine learning", "field"), ("Cambridge", "location")} <= got
    assert {r.relation for r in T.extract_relations(docs).collect()} >= {"works_at", "works_at_org"}
    m = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 5, "c")], "doc_id int, sentence int, entity string")
    assert [(r.a, r.b) for r in T.sentence_cooccurrence(m, 1).collect()] == [("a", "b")] and T.sentence_cooccurrence(m, 0).count() == 3
    ids = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "id string, text string")
    assert len({r.id for r in T.disambiguate(ids, "id", "text").collect()}) == 3


def test_long_runs_do_not_exhaust_the_matcher(spark):
    long = "For " * 20000
    docs = spark.createDataFrame([(1, long), (2, "\n" * 50000), (3, '"' + "a" * 100000 + '"'), (4, long + "Institute")], "doc_id int, text string")
    assert T.extract_entities(docs).count() > 0 and T.extract_relations(docs).count() == 0
    from millrace.sources import io

    out = docs.select(F.length(T.normalise(F.col("text"))), F.size(T.history_citations(F.col("text"))), io.json_structure(F.col("text"))["n_keys"], F.length(T.html_text(F.col("text"))))
    assert out.collect()[1][0] == 2
