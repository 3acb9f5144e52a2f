"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, the targets follow from the sums, and each document is then taken
floor(rate) times plus once more with probability rate - floor(rate), decided by a hash of its doc_id.
The draw needs nothing but the row, so no source, however large, is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.texts import WORD, fresh
from millrace.shared import write_table

#: Fixed values of the mix.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: The draw's resolution: 13 hexadecimal digits of a SHA-256, exact in a double.
DIGITS = 13


def size(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sums: DataFrame) -> DataFrame:
    """sums(source, cap) with rank from 0 by code point, null last, without gathering the rows in one task.

    Ranges of sources are numbered on their own and shifted by the count of those before.
    """
    key = F.coalesce(F.encode(F.col("source"), "UTF-8"), F.lit(b"")).alias("k")
    ranged = sums.select("source", "cap", F.isnull("source").alias("last"), key).repartitionByRange("last", "k")
    placed = write_table(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    shift = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = parts.select("part", F.coalesce(shift, F.lit(0)).alias("shift"))
    local = F.row_number().over(W.partitionBy("part").orderBy("last", "k")) - 1
    return placed.withColumn("local", local).join(before, "part").select("source", "cap", (F.col("local") + F.col("shift")).alias("rank"))


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sums(source, source_size) -> source, source_size, target, rate.

    ``share`` of all sizes is dealt out by weight. A source's target stops at ``most`` times its size;
    what it leaves is dealt out again among the others until none is above. The level L at which
    target = min(cap, weight * L) is found by rounds of two sums over the sources.
    """
    ranked = _ranked(sums.select("source", (F.col("source_size") * most).alias("cap")))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    dealt = write_table(ranked.select("source", "cap", weight.cast("long").alias("weight")), "mix-weights")
    total = dealt.agg(F.sum("cap")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = dealt.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("c"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        new = (share * (total / most) - (row["c"] or 0)) / row["w"] if row["w"] else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return dealt.select("source", (F.col("cap") / most).cast("long").alias("source_size"), target.alias("target"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that only doc_id decides."""
    digits = F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("null")), 256), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies: a row for each row of docs.

    Null texts have size 0, null sources are one source, ranked last. A source without any word has
    target 0 and rate 0. Rows that repeat a doc_id draw alike. An empty table gives no rows; further
    columns are ignored.
    """
    sized = write_table(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size(F.col("text")).alias("size")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = write_table(targets(sums, weights, share, most), "mix-targets")
    goal = goal.withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    # A hot source's rows are numbers only, and adaptive execution splits them where a task has too many.
    return sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """docs' rows, each as often as the mix takes it, with docs' columns, whatever their names.

    Repeated rows are each taken as often; an empty table gives no rows.
    """
    doc, h, times, copy = (fresh(docs, n) for n in ("doc", "hash", "times", "copy"))
    n = plan(docs).filter("copies > 0").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(h), F.col("copies").cast("int").alias(times)).distinct()
    taken = docs.join(n, docs["doc_id"].eqNullSafe(n[doc]) & (F.xxhash64(docs["text"]) == n[h]))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
