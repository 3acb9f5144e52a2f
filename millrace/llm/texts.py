"""What the operators on texts share: how texts reach Python, and how words are cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shared import ship

#: Java's form of the class of word characters; Python's bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes and rows of an Arrow batch, the same for every operator: settings are read when a plan runs, not when it is made.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null gives none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def per_row(docs: DataFrame, keep: list[str], fields: list[tuple[str, str, pa.DataType]], make: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """docs(keep..., text) -> keep... and the fields that ``make()(utf-8 bytes)`` gives for each row.

    ``make`` runs once a task, so that it can hold caches. One Arrow batch is in memory at a time.
    """
    small_batches(docs.sparkSession)
    inp = docs.select(*keep, utf8(F.col("text")).alias("text"))
    schema = ", ".join([*(f"`{c}` {inp.schema[c].dataType.simpleString()}" for c in keep), *(f"{n} {t}" for n, t, _ in fields)])
    names = [n for n, _, _ in fields]
    kinds = [k for _, _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out: list[tuple[Any, ...]] = [f(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *names])

    return inp.mapInArrow(run, schema)
