"""Lineage and legal-record helpers: likeness, boundaries, validators, merged settings, keys in time."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Risk of a boundary between kinds of systems.
BOUNDARY_RISK = {"organization": "high", "system": "medium", "format": "low"}


def similarity(a_type: Column, a: Column, b_type: Column, b: Column) -> Column:
    """Half for the same type and half for the share of metadata entries (of two maps) that are equal."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    same = F.size(F.array_intersect(F.map_entries(a), F.map_entries(b)))
    return F.when(a_type == b_type, 0.5).otherwise(0.0) + F.when(F.size(keys) > 0, 0.5 * same / F.size(keys)).otherwise(0.0)


def find_similar(nodes: DataFrame, node: str, threshold: float = 0.5) -> DataFrame:
    """nodes(id, node_type, metadata) -> id, score above the threshold of nodes like one."""
    one = nodes.filter(F.col("id") == node).select(F.col("node_type").alias("t"), F.col("metadata").alias("m"))
    both = nodes.filter(F.col("id") != node).crossJoin(F.broadcast(one.limit(1)))  # one row
    return both.select("id", similarity(F.col("node_type"), F.col("metadata"), F.col("t"), F.col("m")).alias("score")).filter(F.col("score") > threshold).orderBy(F.desc("score"), "id")


def boundary(a: Column, b: Column) -> Column:
    """The first of organization, system and format in which two metadata maps differ; null if in none."""
    out = F.lit(None).cast("string")
    for k in reversed(list(BOUNDARY_RISK)):
        out = F.when(F.coalesce(a[k] != b[k], F.lit(False)), F.lit(k)).otherwise(out)
    return out


def boundary_risk(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in BOUNDARY_RISK.items() for x in kv)), kind)


def citation_errors(rows: DataFrame, first_year: int = 1776, last_year: int = 2100) -> DataFrame:
    """rows(cid, citation, date, code_type, class_code) -> rows with date_error, format_error and code_error, null where all is well."""
    year = F.regexp_extract("citation", r"\((\d{4})\)\s*$", 1).try_cast("int")
    date_error = F.when(~year.between(first_year, last_year), "the year is out of range").when(F.col("date").isNotNull() & (F.year("date") != year), "year and date differ")
    format_error = F.when(~F.col("citation").rlike(r"^.+,\s.+\s§\s?[\w.-]+\s\(\d{4}\)$"), "the citation's form isn't right")
    wanted = F.when(F.col("class_code").startswith("C"), "municipal").when(F.col("class_code").startswith("H"), "county")
    code_error = F.when(wanted.isNotNull() & (F.col("code_type") != wanted), "code and place don't fit")
    return rows.withColumns({"date_error": date_error, "format_error": format_error, "code_error": code_error})


def deep_merge(base: dict, over: dict) -> dict:
    """Nested settings; ``over`` wins, dictionaries are merged."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def metadata_for(vectors: int, metadata: object) -> list[dict]:
    """One dictionary for each vector: one (or a list of one) is repeated, and a list of another length gives the index only."""
    if isinstance(metadata, dict):
        return [dict(metadata) for _ in range(vectors)]
    if isinstance(metadata, list) and len(metadata) == 1:
        return [dict(metadata[0]) for _ in range(vectors)]
    if isinstance(metadata, list) and len(metadata) == vectors:
        return [dict(m) for m in metadata]
    return [{"vector_index": i} for i in range(vectors)]


def live(created: Column, ttl_seconds: Column, now: Column) -> Column:
    """Whether a record with a time to live is still good; without one it always is."""
    return ttl_seconds.isNull() | (F.unix_timestamp(created) + ttl_seconds > F.unix_timestamp(now))


def iso_time(text: Column) -> Column:
    """An ISO-8601 text as a timestamp in UTC; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def raw_cid(content: bytes) -> str:
    """Version 1 content id, raw codec, SHA-256, base 32."""
    digest = b"\x01\x55\x12\x20" + hashlib.sha256(content).digest()
    return "b" + base64.b32encode(digest).decode().lower().rstrip("=")


def hashed_terms(words: Column, size: int = 1024) -> Column:
    """A sparse vector as a map of index to count, indices by hash."""
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(at), lambda i: F.struct(i, F.size(F.filter(at, lambda j: j == i)))))


def corpus_query(kind: str, sources: dict[str, DataFrame], most: int = 10, least: float = 0.7) -> DataFrame:
    """The rows of a kind of query (semantic, entity, relationship, hybrid, cross_document) that reach a confidence, best first."""
    if kind not in ("semantic", "entity", "relationship", "hybrid", "cross_document") or kind not in sources:
        raise ValueError(f"no source for {kind}")
    return sources[kind].filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(most)
