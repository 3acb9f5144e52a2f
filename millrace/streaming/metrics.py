"""Event metrics as streams: the same shapes as the batch forms, bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(path)


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "5 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, keys, n, total, mean of each window; events later than the watermark are dropped. Works on streams and tables."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of stretches without a gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def limiter(events: DataFrame, key: str, ts: str, calls: int, period: int, late: str = "1 hour") -> DataFrame:
    """key, ts, allowed: as the batch rate limit, with the calls let in within a period as state, dropped once the watermark has passed them.

    Calls are taken in order within a trigger; one that comes after a later one was decided in an earlier trigger is judged by what is still held.
    """
    kind = dict(events.dtypes)[key]

    def step(group: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("t")
        out = []
        for t in rows["t"].tolist():
            held = [h for h in held if t - h < period * 1_000_000]
            out.append(len(held) < calls)
            if out[-1]:
                held.append(t)
        state.update((held,))
        state.setTimeoutTimestamp(max(max(rows["t"]) // 1000 + period * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [group[0]] * len(rows), "t": rows["t"], "allowed": out})

    keyed = events.withWatermark(ts, late).select(F.col(key).alias("k"), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    found = keyed.groupBy("k").applyInPandasWithState(step, f"k {kind}, t bigint, allowed boolean", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), "allowed")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, as a table: for tests and backfills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
