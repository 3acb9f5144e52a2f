"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, licenses, mixing, quality_model, quality_rules, simhash, suffix_dedup, tiff, toxicity, url_rules
from millrace.llm.texts import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash_neardup, op3_suffix_dedup, op4_mixing, op5_quality_model, op6_url_rules, op7_byte_bpe, op8_license_scan, op9_tiff_media, op10_quality_rules)}


#: The level at which sources that aren't capped are filled is found in order of cap over weight.
_MIXING = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap from sized group by source),
ranked as (select *, [3, 1, 2][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as weight from sums),
run as (select *, coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as after, sum(cap) over () as total from ranked),
levels as (select (1.5 * (total / 2) - before) / after as level, cap, weight, row_number() over (order by cap / weight, source) as rn from run),
chosen as (select level from levels where cap > level * weight order by rn limit 1),
goal as (select source, source_size, least(cap::double, weight * (select level from chosen)) as target from ranked),
rates as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from sized s join goal g on s.source is not distinct from g.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + (('0x' || substr(sha256(coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0 < rate - floor(rate))::bigint) as taken from rates
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _MIXING}
