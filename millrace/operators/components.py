"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each round is two aggregations and two joins on the node, written to the
shared folder so that the plan does not grow. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import write_table


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v seen from u, and the least node m seen from u (u included)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = _star(down)
    out = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).union(seen.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, component), component being the least node.

    Self-loops, repeated edges and edges with a null end are ignored, so a node that only has those
    is absent. No edges: no rows. Raises if ``max_rounds`` do not suffice (a path of 2**30 nodes needs
    about 30), rather than return a partial answer.
    """
    now = edges.select("u", "v").filter("u is not null and v is not null and u != v")
    now = write_table(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or mark == (row["n"], row["h"]):
            break
        mark = (row["n"], row["h"])
        now = write_table(_small(_large(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
