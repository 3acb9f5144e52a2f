"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def training(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """doc_id, y of at most ``most`` labelled rows: those whose doc_id hashes lowest.

    Rows without doc_id or label teach nothing; of several labels for a doc_id the largest counts.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(learn & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
