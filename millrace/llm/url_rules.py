"""URL filters by association rules, with DataFrame functions and Spark's FP-growth only.

Base rules judge what they fit; from their verdicts, and from hosts with a listed name part, come the URLs
labelled bad. All others count against a rule, the unjudged ones too, so that a token is only
blamed if nearly all URLs with it are bad. FP-growth mines which combinations of URL tokens go with the label; rules
below a support or confidence are dropped, as are those that a shorter rule makes needless. The rest are
posted under their rarest token, and a URL that has that token is checked for the others.

Mining stays small without losing a rule that could decide anything: it leaves out tokens below the support among
bad URLs, tokens of no unjudged URL, tokens that are a rule by themselves, and all but one of tokens that always occur together.

Scale: URLs collapse to distinct token sets before rules are matched, so a host with a third of all
pages is matched once per set. The mined alphabet is sent to all tasks: a token in it has at least the support, so there
are at most as many as a URL has tokens on average, divided by the support.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.shared import write_table

#: Fixed values of the base rules: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Parts of host names that label a URL as one to block.
BLOCKED_PARTS = ("ads", "adult", "bets", "casino", "gambling", "malware", "phishing", "porn", "spam", "track", "tracker", "xxx")
#: Least share of all URLs that are bad and have the tokens, least number of them, and least share of bad ones among those that have the tokens.
SUPPORT, LEAST, CONFIDENCE = 0.001, 10, 0.95

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def base_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as (rule, verdict); null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens() -> Column:
    """A URL's tokens from url, host and path: top-level domain, the parts of host labels, path segments, extension, query keys with their values, fragment.

    Numbers are no tokens, and a query value that is one stands as its key. Rare tokens fall below the support and don't lengthen the mined item sets.
    """
    labels = F.split("host", r"\.")
    parts = F.filter(F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(1))), lambda x: F.split(x, "-"))), lambda x: ~x.rlike(r"^\d*$"))
    segments = F.filter(F.split("path", "/"), lambda x: ~x.rlike(r"^\d*(\.\w*)?$"))
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    pairs = F.filter(F.regexp_extract_all("url", F.lit(r"[?&]([^=&#]+(=[^&#]*)?)"), 1), lambda x: x != "")
    plain = F.transform(pairs, lambda x: F.regexp_replace(x, r"=\d*$", "="))
    all_ = F.concat(
        F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)), F.when(extension != "", F.concat(F.lit("ext:"), extension)), F.when(F.col("url").contains("#"), F.lit("fragment"))),
        F.transform(parts, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("in:"), x)),
        F.transform(plain, lambda x: F.concat(F.lit("query:"), x)),
    )
    return F.array_sort(F.array_distinct(F.array_compact(all_)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, own: DataFrame | None = None) -> DataFrame:
    """labelled(tokens, bad), a row for each URL -> rule, tokens: minimal combinations of which at least ``confidence`` of all URLs are bad, and at least ``support`` of all URLs.

    With ``own`` (tokens), only combinations that could fit one of these. Tokens that always occur together are one, the least. No bad URL: no rules.
    """
    total = labelled.count()
    least = max(support * total, least)
    by_token = labelled.select(F.explode("tokens").alias("token"), "bad", F.xxhash64("tokens", "bad").cast("decimal(38,0)").alias("h"))
    counts = by_token.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.sum("h").alias("h")).filter(F.col("b") >= least)
    if own is not None:
        counts = counts.join(own.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    classes = write_table(counts.groupBy("n", "b", "h").agg(F.min("token").alias("token")), "url-alphabet")
    alone = classes.filter(F.col("b") >= confidence * F.col("n")).select(F.array("token").alias("tokens"))
    rest = classes.filter((F.col("b") < confidence * F.col("n")) & (F.col("n") < total)).agg(F.array_sort(F.collect_list("token")).alias("alphabet"))
    items = labelled.join(F.broadcast(rest)).withColumn("items", F.array_intersect("tokens", "alphabet")).filter(F.size("items") > 0)
    marked = items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit("verdict:block")))).otherwise(F.col("items")).alias("items"))
    marked = write_table(marked, "url-items")
    n = marked.count()
    if not n:
        return write_table(alone, "url-rules").select(F.xxhash64("tokens").alias("rule"), "tokens")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=confidence).fit(marked)
    sets = write_table(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-item-sets")
    blocked = sets.filter(F.array_contains("items", "verdict:block") & (F.size("items") > 1)).select(F.array_remove("items", "verdict:block").alias("items"), F.col("freq").alias("b"))
    sure = blocked.join(sets, "items").filter(F.col("b") >= confidence * F.col("freq")).select(F.col("items").alias("tokens"))
    rules = write_table(alone.union(sure), "url-rules").select(F.xxhash64("tokens").alias("rule"), "tokens")
    # A rule is needless where another's tokens are a part of its own.
    smaller = match(rules.select("tokens"), rules, strict=True)
    return rules.join(smaller, "tokens", "left_anti")


def match(sets: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """sets(tokens) -> tokens of those that hold all tokens of some rule (and others, if ``strict``), by the rarest token of each rule."""
    how_often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("rule", "tokens", F.explode("tokens").alias("token")).join(how_often, "token")
    index = posted.groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("needed"))
    seen = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    held = (F.size(F.array_except("needed", "tokens")) == 0) & (F.size("needed") < F.size("tokens") + (0 if strict else 1))
    return seen.filter(held).select("tokens").distinct()


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of pages.

    A null URL, or one without "://", has an empty host and path and fits no rule; the method allows
    what no mined rule blocks. Equal URLs get equal answers; an empty table gives no rows; further
    columns are ignored. Very long URLs are judged whole: rare tokens take no part in mining.
    """
    name, verdict = base_rule(rules)
    cut = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = cut.withColumns({"rule": name, "base": verdict, "tokens": F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens())}).drop("url")
    ruled = write_table(ruled, "url-tokens")
    listed = F.arrays_overlap("tokens", F.array(*(F.lit(f"host:{p}") for p in BLOCKED_PARTS)))
    marked = ruled.filter(F.size("tokens") > 0).withColumn("bad", listed | F.coalesce(F.col("base") == "block", F.lit(False)))
    own = write_table(marked.filter("base is null").select("tokens").distinct(), "url-sets")
    bad = match(own, mine(marked.select("tokens", "bad"), support, confidence, least, own)).withColumn("bad", F.lit(True))
    out = ruled.join(bad, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("base", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
