"""Cleaning and joining of record sets."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.registry import haversine_km
from millrace.operators.components import connected_components
from millrace.operators.stats import micros
from millrace.shared import write_table


def exact_dedup(df: DataFrame, content: str, name: str, canonical: Column | None = None) -> DataFrame:
    """One row of each content: canonical ones first (all of these stay), then the shortest name, then the least."""
    canonical = F.lit(False) if canonical is None else canonical
    w = W.partitionBy(F.sha2(F.col(content).cast("binary"), 256)).orderBy(canonical.desc(), F.length(name), name)
    return df.withColumn("__c", canonical).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1 or __c").drop("__c", "__rn")


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """The parts one after another; of equal keys the earliest part's stays."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    order = [F.col("__part"), *(F.col(c) for c in parts[0].columns if c != key)]
    return all_.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn", "__part")


def newest_per_group(df: DataFrame, title: str, created: str, key: str, mask: str = r"\d+") -> DataFrame:
    """The newest row of each title, numbers in titles set aside."""
    w = W.partitionBy(F.regexp_replace(title, mask, "#")).orderBy(F.desc(created), F.desc(key))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def coverage(df: DataFrame, group: str, family: str, wanted: list[str]) -> DataFrame:
    """group, n_families, coverage: full, partial or none of the wanted families."""
    has = F.countDistinct(F.when(F.col(family).isin(wanted), F.col(family)))
    out = df.groupBy(group).agg(has.alias("n_families"))
    return out.withColumn("coverage", F.when(F.col("n_families") == len(wanted), "full").when(F.col("n_families") > 0, "partial").otherwise("none"))


def key_audit(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """key, missing_in: keys that aren't in all the tables."""
    rows = reduce(DataFrame.union, [t.select(F.col(key), F.lit(n).alias("t")).distinct() for n, t in tables.items()])
    names = F.array(*(F.lit(n) for n in sorted(tables)))
    return rows.groupBy(key).agg(F.array_sort(F.array_except(names, F.collect_set("t"))).alias("missing_in")).filter(F.size("missing_in") > 0)


def like_search(df: DataFrame, columns: list[str], query: str, order: str, limit: int = 20) -> DataFrame:
    """Rows with the query in any of the columns, whatever the case."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(query.lower()) for c in columns])
    return df.filter(hit).orderBy(order).limit(limit)


def email_search(emails: DataFrame, query: str, field: str = "all") -> DataFrame:
    """Substring of all fields, or of subject, from, to or body."""
    fields = {"subject": ["subject"], "from": ["from"], "to": ["to"], "body": ["body_text"], "all": ["subject", "from", "to", "body_text"]}
    if field not in fields:
        raise ValueError(f"no field {field}")
    return emails.filter(F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in fields[field]))).contains(query.lower()))


def email_analytics(emails: DataFrame) -> DataFrame:
    """One row: count, earliest, latest, attachments and their bytes, average body length, threads and those with more than one reply."""
    a = emails.agg(F.count("*").alias("n"), F.min("date").alias("earliest"), F.max("date").alias("latest"), F.sum(F.size("attachments")).alias("n_attachments"), F.sum(F.aggregate("attachments", F.lit(0).cast("long"), lambda s, x: s + x["size"])).alias("attachment_bytes"), F.avg(F.length("body_text")).cast("int").alias("avg_body"))
    t = emails.filter(F.col("in_reply_to").isNotNull()).groupBy("in_reply_to").count().agg(F.count("*").alias("n_threads"), F.count_if(F.col("count") > 1).alias("n_long_threads"))
    return a.crossJoin(t)  # a row each


def redact(properties: Column, words: tuple[str, ...] = ("password", "secret", "token", "key", "credential"), most: int = 128) -> Column:
    """A map whose sensitive keys are masked and whose values are cut to ``most`` characters."""
    bad = lambda k: reduce(lambda a, b: a | b, [F.lower(k).contains(w) for w in words])
    return F.transform_values(properties, lambda k, v: F.when(bad(k), F.lit("[REDACTED]")).otherwise(F.left(v, F.lit(most))))


def coarse(lat: Column, lon: Column, digits: int = 2) -> Column:
    return F.struct(F.round(lat, digits).alias("lat"), F.round(lon, digits).alias("lon"))


def location_commitment(lat: Column, lon: Column, salt: Column) -> Column:
    return F.sha2(F.format_string("%.6f|%.6f|%s", lat, lon, salt), 256)


def within_radius(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """a(id, lat, lon), b(id, lat, lon) -> a_id, b_id, km. Cells as high as the radius make it an equality join; the date line is bridged.

    Cells are bands of latitude cut by longitude at a width that holds the radius at the band's edge nearest a pole.
    """
    size = max(km / 111.0, 0.01)
    bands = lambda lat: F.floor((lat + 90) / size).cast("int")

    def width(band: Column) -> Column:
        edge = F.greatest(F.abs(band * size - 90), F.abs((band + 1) * size - 90)) + size
        reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(size))) / F.cos(F.radians(F.least(edge, F.lit(89.9)))))))
        return F.when(edge + size >= 90, 360.0).otherwise(reach)

    left = a.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    left = left.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bands(F.col("a_lat")) + d)))
    n = F.greatest(F.floor(360.0 / width(F.col("band"))), F.lit(1))
    cell = lambda lon: F.floor((lon + 180) / (360.0 / n))
    left = left.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(cell(F.col("a_lon")) + d, n) for d in (-1, 0, 1))))))
    right = b.select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")).withColumn("band", bands(F.col("b_lat")))
    right = right.withColumn("cell", F.pmod(cell(F.col("b_lon")), n))
    out = left.join(right, ["band", "cell"]).withColumn("km", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return out.filter(F.col("km") <= km).select("a_id", "b_id", "km")


def window_pairs(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """left(id, ts), right(id, ts): pairs whose right follows within ``seconds``: an equality join on time slots of that length."""
    slot = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = left.select(F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), F.explode(F.array(slot("ts"), slot("ts") + 1)).alias("slot"))
    b = right.select(F.col("id").alias("b_id"), F.col("ts").alias("b_ts"), slot("ts").alias("slot"))
    gap = micros(F.col("b_ts")) - micros(F.col("a_ts"))
    return a.join(b, "slot").filter(gap.between(0, seconds * 1_000_000)).select("a_id", "b_id", (gap / 1_000_000).alias("lag_s"))


def correlations(df: DataFrame, group: str, x: str, y: str, k: int = 10) -> DataFrame:
    """group, r: Pearson's r of the k groups with the largest either way."""
    return df.groupBy(group).agg(F.corr(x, y).alias("r")).filter("r is not null and not isnan(r)").orderBy(F.desc(F.abs("r")), group).limit(k)


def cluster_mentions(mentions: DataFrame) -> DataFrame:
    """mentions(id, pos, text, label, doc_id, confidence) -> key and what is first of each lower-cased text, its documents (none counts as one) and mean confidence."""
    first = F.min_by(F.struct("id", "text", "label"), "pos")
    docs = F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    g = mentions.groupBy(F.lower("text").alias("key")).agg(first.alias("f"), docs.alias("n_docs"), F.count("*").alias("n_mentions"), F.avg("confidence").alias("confidence"))
    return g.select("key", "f.*", "n_docs", "n_mentions", "confidence")


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """mentions(name, entity_id, doc_id, confidence) -> name, documents, mentions, and the mean of its entities' means."""
    one = mentions.groupBy("name", "entity_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("m"))
    docs = mentions.groupBy("name").agg(F.countDistinct("doc_id").alias("n_docs"))
    return one.groupBy("name").agg(F.sum("n").alias("n_mentions"), F.avg("m").alias("confidence")).join(docs, "name")


def pattern_stats(patterns: DataFrame) -> DataFrame:
    """patterns(type, confidence) -> type, n, mean, min, max, and bands above 0.8, from 0.6, below."""
    c = F.col("confidence")
    return patterns.groupBy("type").agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.count_if(c > 0.8).alias("high"), F.count_if(c.between(0.6, 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"))


def bins(events: DataFrame, ts: str, lat: str, lon: str, unit: str = "day", cell_km: float = 50.0) -> DataFrame:
    """period, cell_lat, cell_lon, n: events by time and grid cell."""
    step = cell_km / 111.0
    return events.groupBy(F.date_trunc(unit, ts).alias("period"), F.floor(F.col(lat) / step).alias("cell_lat"), F.floor(F.col(lon) / step).alias("cell_lon")).agg(F.count("*").alias("n"))


def queue_next(tasks: DataFrame) -> DataFrame:
    """The oldest queued task: a look, no claim."""
    return tasks.filter("status = 'queued'").orderBy("created_at", "task_id").limit(1)


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of a lookup table(key unique); rows without an entry go. Spark broadcasts the table if its size allows."""
    return rows.join(table, key)


def fuzzy_dedup(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of rows whose columns are equal but for case, marks and white space, the one that is first by ``order``."""
    plain = [F.regexp_replace(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " ") for c in columns]
    w = W.partitionBy(*(F.trim(c) for c in plain)).orderBy(order)
    name = "rn_" + "_".join(df.columns)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) == 1).drop(name)


#: Bits of the six blocks that a 64-bit signature is cut into; of two within three bits, three blocks at least are equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def simhash64(docs: DataFrame) -> DataFrame:
    """doc_id, fp: a bit for each of the first 64 of the SHA-1 of shingles of three words [a-z0-9]+ (fewer: all), set where at least half have it. No words: 0."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    own = docs.select("doc_id", words.alias("w"))
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    shingles = own.select("doc_id", F.explode_outer(F.transform(starts, lambda i: F.conv(F.substring(F.sha1(F.array_join(F.slice("w", i, 3), " ")), 1, 16), 16, -10).cast("long"))).alias("h"))
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    sums = shingles.groupBy("doc_id").agg(F.count("h").alias("n"), *bits)
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when((F.col("n") > 0) & (2 * F.col(f"b{i}") >= F.col("n")), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select("doc_id", fp.alias("fp"))


def simhash_groups(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, fp, group_id: the least doc_id that links of at most three bits reach. Signatures meet on three equal blocks of six, which no such pair lacks."""
    if most > 3:
        raise ValueError("the blocks are complete up to three bits")
    signed = write_table(simhash64(docs), "signatures")
    one = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in BLOCKS]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), *(part[i].alias(f"x{j}") for j, i in enumerate(c))) for k, c in enumerate(combinations(range(6), 3))))
    # Spark takes the twenty keys of a signature for one row, and files of signatures for what they are packed: unhinted, the driver would collect a side to broadcast it.
    keyed = one.select("fp", F.explode(keys).alias("key"))
    near = keyed.alias("a").hint("merge").join(keyed.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = near.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    groups = connected_components(pairs).withColumnRenamed("node", "fp")
    of = one.hint("merge").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.groupBy("component").agg(F.min("least").alias("group_id"))
    return signed.hint("merge").join(of.hint("merge").join(named, "component").select("fp", "group_id"), "fp").select("doc_id", "fp", "group_id")
