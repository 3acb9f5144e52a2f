"""Statistics, ranks, windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.shared import write_table


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without a time zone (then the session's)."""
    return F.unix_micros(ts.cast("timestamp"))


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """df with rank from 1 by the columns: ranges are numbered on their own and shifted by the count of those before."""
    placed = write_table(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("__part").count()
    shift = F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__n", local).join(sizes.select("__part", shift.alias("__s")), "__part").withColumn("rank", F.col("__n") + F.col("__s")).drop("__part", "__n", "__s")


def percentile_nearest(value: Column, p: float) -> Column:
    """Aggregate: the element at round-half-even(p (n - 1)) in order."""
    a = F.array_sort(F.collect_list(value))
    return F.get(a, F.bround(F.lit(p) * (F.size(a) - 1)).cast("int"))


def percentile_lower(value: Column, p: float, empty: float = 0.5) -> Column:
    """Aggregate: the element at floor(p (n - 1)) in order; ``empty`` if there are none. ``p`` is in [0, 1]."""
    a = F.array_sort(F.collect_list(value))
    return F.coalesce(F.get(a, F.floor(F.lit(p) * (F.size(a) - 1)).cast("int")), F.lit(empty))


def exact_percentile(df: DataFrame, group: list[str], value: str, p: float, mode: str = "nearest") -> DataFrame:
    """group, percentile as the aggregates above, without a list of all values in a row: equal values are counted first."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    at = F.bround(p * (F.col("total") - 1)) if mode == "nearest" else F.floor(p * (F.col("total") - 1))
    return run.groupBy(*group).agg(F.min(F.when(F.col("upto") > at, F.col(value))).alias("percentile"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, mean, min, max, stdev (0 for one row)."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("dimension").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stdev"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """bin, n over [0, 1] in equal bins, the last closed; empty bins are 0."""
    b = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(value.between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int) -> DataFrame:
    """Exactly allocated by largest remainder, at least one each; within a stratum by the MD5 of the key."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") * total / F.lit(float(max(n, 1)))
    quota = F.least(F.col("n"), F.greatest(F.floor(share), F.lit(1)))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)))
    return ranked.join(sizes.select(stratum, quota.alias("__q")), stratum).filter(F.col("__rn") <= F.col("__q")).drop("__rn", "__q")


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def delta(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with previous and delta: value minus the one before; null where either is missing."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("previous", before).withColumn("delta", F.col(value) - before)


def map_delta(new: Column, old: Column) -> Column:
    """Per key the difference of two maps; null where a key is missing in either."""
    return F.map_zip_with(new, old, lambda k, a, b: a - b)


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n, in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of 0/1 columns."""
    c = lambda a, p: F.count_if((actual == a) & (predicted == p))
    s = df.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    s = s.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def trailing(events: DataFrame, keys: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """events with n, total, mean of the last ``seconds`` up to each, both ends included."""
    w = W.partitionBy(*keys).orderBy(micros(F.col(ts))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumns({"n": F.count("*").over(w), "total": F.sum(value).over(w), "mean": F.avg(value).over(w)})


def over_limit(events: DataFrame, key: str, ts: str, calls: int, period: int) -> DataFrame:
    """events with over: more than ``calls`` within the last ``period`` seconds, the far end excluded. All events count."""
    w = W.partitionBy(key).orderBy(micros(F.col(ts))).rangeBetween(-period * 1_000_000 + 1, 0)
    return events.withColumn("over", F.count("*").over(w) > calls)


def rate_limit(events: DataFrame, key: str, ts: str, calls: int, period: int) -> DataFrame:
    """key, ts, allowed: a call is let in if fewer than ``calls`` were let in during the last ``period`` seconds. Rejected ones aren't counted.

    A key's calls are scanned in order in a sorted partition; only the calls let in within a period are held.
    """
    when = micros(F.col(ts)).alias("t")
    kind = events.schema[key].dataType.simpleString()
    ordered = events.select(F.col(key).alias("k"), when).repartition("k").sortWithinPartitions("k", "t")

    def run(batches):
        import collections

        import pandas as pd

        now, held = None, collections.deque()
        for b in batches:
            ok = []
            for k, t in zip(b["k"].tolist(), b["t"].tolist(), strict=True):
                if k != now:
                    now, held = k, collections.deque()
                while held and t - held[0] >= period * 1_000_000:
                    held.popleft()
                ok.append(len(held) < calls)
                if ok[-1]:
                    held.append(t)
            yield pd.DataFrame({"k": b["k"], "t": b["t"], "allowed": ok})

    return ordered.mapInPandas(run, f"k {kind}, t bigint, allowed boolean").select(F.col("k").alias(key), F.timestamp_micros("t").alias(ts), "allowed")


def provider_snapshot(events: DataFrame, window_seconds: int) -> DataFrame:
    """events(provider, operation, success, latency_ms, items, quality) -> totals, rates, p95 by nearest rank, throughput."""
    keys = ["provider", "operation"]
    agg = events.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("success").alias("successes"), F.avg("latency_ms").alias("avg_latency_ms"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.avg("quality").alias("avg_quality"))
    p95 = exact_percentile(events, keys, "latency_ms", 0.95).withColumnRenamed("percentile", "p95_latency_ms")
    out = agg.join(p95, keys, "left")
    return out.withColumns({"failures": F.col("total") - F.col("successes"), "success_rate": F.col("successes") / F.col("total"), "throughput": F.col("items") / F.lit(float(window_seconds))})


def provider_score(snapshot: DataFrame, weights: dict[str, float], targets: dict[str, float], cost: Column | None = None) -> DataFrame:
    """snapshot with score: weighted sum of throughput, success_rate, latency, quality and cost, each clamped to [0, 1]."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {"throughput": clamp(F.col("throughput") / targets["throughput"]), "success_rate": clamp(F.col("success_rate")), "latency": clamp(1 - F.col("avg_latency_ms") / targets["latency"]), "quality": clamp(F.coalesce("avg_quality", F.lit(0.0))), "cost": clamp(1 - (cost if cost is not None else F.lit(0.0)) / targets["cost"])}
    score = F.lit(0.0)
    for name, c in parts.items():
        score = score + weights.get(name, 0.0) * c
    return snapshot.withColumn("score", score)


def query_stats(log: DataFrame, recent_seconds: int = 300) -> DataFrame:
    """log(ts, pattern, seconds, hit) -> counts, avg, min, max, hit rate, and the average of the last seconds."""
    last = log.agg(F.max("ts").alias("last"))
    both = log.crossJoin(F.broadcast(last))  # one row
    recent = F.when(F.unix_timestamp("last") - F.unix_timestamp("ts") <= recent_seconds, F.col("seconds"))
    return both.agg(F.count("*").alias("n"), F.avg("seconds").alias("avg"), F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(recent).alias("recent_avg"))


def cohort_counts(df: DataFrame, group: str, least: int = 10, epsilon: float = 1.0, sensitivity: float = 1.0, seed: str = "") -> DataFrame:
    """group, n, noisy: cohorts of at least ``least``, with Laplace noise that the group and the seed decide; never below 0."""
    counts = df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.lit("|"), F.col(group).cast("string")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    centred = F.greatest(F.least(u, F.lit(1 - 2.0**-53)), F.lit(2.0**-53)) - 0.5
    noise = -(sensitivity / epsilon) * F.signum(centred) * F.log(1 - 2 * F.abs(centred))
    return counts.withColumn("noisy", F.greatest(F.lit(0.0), F.col("n") + noise))


def outliers(df: DataFrame, value: str, z: float = 3.0) -> DataFrame:
    """Rows whose z-score exceeds ``z`` either way, with the score; nothing where all values are alike."""
    m = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    score = F.when(F.col("s") > 0, (F.col(value) - F.col("m")) / F.col("s"))
    return df.crossJoin(F.broadcast(m)).withColumn("z", score).filter(F.abs("z") > z).drop("m", "s")  # one row


def kmeans(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vectors(id, vec) -> id, cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """vectors(id, vec) -> id, vec of k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(data).transform(data).select("id", vector_to_array("pc").alias("vec"))
