"""Tables that outlive a lost executor: everything iterative or reused is cut off here."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster names it.

    Only a session in one process (tests, a laptop) may leave it unset and gets a local folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("millrace.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.shared.dir", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Enough where tasks see the driver's folders (local mode, shared file systems); elsewhere give the
    package to spark-submit with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


#: Paths written in each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession, *done: DataFrame) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that are written within, and ``done`` where they are such tables, at the end; not those passed to what it yields.

    For jobs whose result is written inside: frames made from removed tables can't be read later.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(_roots(df))
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.remove(own)
    for path in [*own, *(p for df in done for p in _roots(df))]:
        if path in kept:
            if _scopes:
                _scopes[-1].append(path)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _roots(df: DataFrame) -> list[str]:
    """The path of a frame that ``write_table`` returned."""
    return [p] if (p := vars(df).get("written")) else []


def write_table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed. Files are replicated by the
    store they lie in, so a lost executor costs only its running tasks. They stay until the folder is
    cleaned or the ``scope`` that they are written in ends, for the frame that is returned reads them lazily.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["written"] = path
    return out
