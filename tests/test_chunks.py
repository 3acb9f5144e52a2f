import pandas as pd
from oracle import compare, connect
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans import catalog

#: Pieces that begin or end with the digits of their place, and marks and spaces of all sorts between and around them.
TEXTS = [
    "Card 4072374829496490", "0. 1 one 1.  2 two 2! 3 3?\t4", "00 first 0\n\n1 second 1\n \t\n 2 third 2", " a. b. \n\n c ", None, "", "   ", "\n\n\n", "... ! ?", "a.\nb.\n\n\nc.",
    " one.  two.　three ", "a.\x0bb. \x0bc", "x\n\x0b\ny\n\x0c\nz", "\tone\t.\ttwo\t", "a\x01b. \x01c", "x\r\n\r\ny\r\n \r\nz", "no break.\u0085here. ​end", "1\n\n1\n\n1", "\x1c. \x1f",
]


def against_sql(spark, tmp_path, name):
    pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}).to_parquet(tmp_path / "documents.parquet")
    compare(spark, connect(tmp_path), str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name])


def test_paragraphs_of_odd_texts_against_sql(spark, tmp_path):
    against_sql(spark, tmp_path, "chunk_paragraphs")


def test_sentences_of_odd_texts_against_sql(spark, tmp_path):
    against_sql(spark, tmp_path, "chunk_sentences")


def test_digits_of_citations_stay(spark):
    row = spark.range(1).select(T.history_citations(F.lit("Text. [1995 c.12 §30; 2001 c.4 §71]")).alias("x")).first()
    assert [tuple(c) for c in row.x] == [("1995", "12", "30"), ("2001", "4", "71")]
