"""Quality rules with thresholds that follow each language and source.

One pass over the texts counts what the rules look at. Each rule's ratio goes, by group, into a
quantile sketch: counts of logarithmic buckets whose width is a sixteenth of the value. Sketches merge by
adding counts, in any order and without loss, so partial ones are summed before the exchange and the
result never depends on how rows were dealt. Each group's thresholds are read from its sketch, fenced
like a box plot (a quantile plus a multiple of its distance to the median), and joined back as a filter.

A group's sketch is merged with its language's as if that had ``PRIOR`` documents: a group of few documents
follows its language, a large one itself, without a size at which one turns into the other. Null languages
and sources are groups like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.texts import per_row
from millrace.shared import write_table

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

FIELDS = [(n, "bigint", pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")]


@dataclass(frozen=True)
class Rule:
    """A whole-number ratio and its fences: q(high) + spread * (q(high) - q50), and with ``low`` the like below.

    ``high`` is the share in percent of a group's documents that the rule takes for ordinary: fewer
    odd ones than the rest don't move the fence. ``unit`` is the least change that counts, for groups without any spread.
    """

    name: str
    ratio: str
    high: int
    spread: int
    unit: int
    low: int | None = None


#: Symbols are all or nothing, so that a quarter may be odd; repeated lines and words are rare in any text, so that their own tail tells what is usual.
RULES = (
    Rule("symbols", "10000 * n_symbols div greatest(n_words, 1)", 75, 6, 100),
    Rule("dup_lines", "10000 * n_dup_lines div greatest(n_lines, 1)", 98, 2, 100),
    Rule("repeats", "10000 * n_repeat_words div greatest(n_words, 1)", 98, 3, 100),
    Rule("capitals", "10000 * n_capitals div greatest(word_chars, 1)", 90, 5, 10),
    Rule("word_length", "100 * word_chars div greatest(n_words, 1)", 90, 5, 100, 10),
)
#: Documents that the language's sketch counts for in a group's.
PRIOR = 200

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)


def _repeated(words: list[bytes]) -> int:
    """Words covered by a window of eight words that occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    seen = [joined[a:b] for a, b in zip(starts, ends[WINDOW - 1 :].tolist(), strict=True)]
    if len(set(seen)) == n:
        return 0
    count: dict[bytes, int] = {}
    for s in seen:
        count[s] = count.get(s, 0) + 1
    twice = np.fromiter((count[s] > 1 for s in seen), bool, n)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    points = len(text.translate(None, _CONTINUATION + _SPACE))
    lines = [s for s in text.split(b"\n") if not s.isspace() and s] if b"\n" in text else ([text] if words else [])
    return (
        len(words),
        points,
        len(text.translate(None, _NOT_SYMBOL)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(text.translate(None, _NOT_CAPITAL)),
    )


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and the counts, a row for each row of docs."""
    with_hash = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text")
    return per_row(with_hash, ["doc_id", "lang", "source", "text_hash"], FIELDS, lambda: count_text)


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number from 0: exact below 32, then a sixteenth wide."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(5), F.lit(0)).cast("int")
    return F.expr("0") + shift.cast("long") * 16 + F.call_function("shiftright", value, shift)


def lower_edge(b: Column) -> Column:
    """The least value in a bucket: inverse of ``bucket``."""
    shift = F.greatest(F.floor(b / 16) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * 16, shift)


def sketches(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """lang, source, rule, b, n: mergeable quantile sketches. Only documents that pass the base rules count."""
    ratios = F.array(*(F.struct(F.lit(i).alias("rule"), bucket(F.expr(r.ratio)).alias("b")) for i, r in enumerate(rules)))
    rows = counted.filter(~base_failed()).select("lang", "source", F.explode(ratios).alias("x"))
    return rows.groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """lang, source and columns lo<i>, hi<i> with the fences of each rule (lo<i> null without one).

    A bucket weighs n * N + prior * m, with n of the group's documents in it, and m of the language's N: whole
    numbers, so that the result is the same however rows were dealt. A group has at most a few hundred buckets.
    """
    by_lang = sketch.groupBy("lang", "rule", "b").agg(F.sum("n").alias("m")).withColumn("all", F.sum("m").over(W.partitionBy("lang", "rule")))
    by_lang = by_lang.select(F.col("lang").alias("l"), F.col("rule").alias("r"), F.col("b").alias("c"), "m", "all")
    groups = sketch.select("lang", "source").distinct()
    whole = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", F.col("r").alias("rule"), F.col("c").alias("b"), "m", "all")
    own = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("rule").alias("r"), F.col("b").alias("c"), "n")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")) & (F.col("b") == F.col("c"))
    big = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(19,0)")
    weight = (big(F.col("n")) * big(F.col("all")) + big(F.col("m")) * prior).cast("decimal(30,0)")
    group = W.partitionBy("lang", "source", "rule")
    run = whole.join(own, same, "left").select("lang", "source", "rule", "b", weight.alias("w"))
    run = run.withColumn("upto", F.sum("w").over(group.orderBy("b")) * 100).withColumn("total", F.sum("w").over(group))
    level = lambda of: F.element_at(F.array(*(F.lit(of(r)) for r in rules)), F.col("rule") + 1)
    reached = lambda share: F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("b")))
    q = run.groupBy("lang", "source", "rule").agg(reached(F.lit(50)).alias("b50"), reached(level(lambda r: r.high)).alias("top"), reached(level(lambda r: r.low or 0)).alias("bottom"))
    mid, top, bottom = (lower_edge(F.col(c)) for c in ("b50", "top", "bottom"))
    spread, unit = level(lambda r: r.spread), level(lambda r: r.unit)
    hi = top + F.greatest(spread * (top - mid), unit)
    lo = F.when(level(lambda r: r.low is not None), bottom - F.greatest(spread * (mid - bottom), unit))
    q = q.select("lang", "source", "rule", hi.alias("hi"), lo.alias("lo"))
    return q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(rules)) for c in ("lo", "hi")))


def _with_limits(docs: DataFrame, rules: tuple[Rule, ...], prior: int) -> DataFrame:
    """stats of docs, with the thresholds of each row's group (null where none of its documents pass the base rules)."""
    counted = write_table(stats(docs), "quality-stats")
    limits = write_table(thresholds(sketches(counted, rules), rules, prior), "quality-thresholds")
    limits = limits.withColumnsRenamed({"lang": "l", "source": "s"})
    # The group is a few bytes and the rows are numbers only; a hot group is split by adaptive execution.
    return counted.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")


def _over(i: int, r: Rule) -> Column:
    return F.coalesce((F.expr(r.ratio) > F.col(f"hi{i}")) | F.coalesce(F.expr(r.ratio) < F.col(f"lo{i}"), F.lit(False)), F.lit(False))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """doc_id, text_hash, the counts, base_failed and kept, a row for each row of docs.

    Null texts have no words and fail the base rules, as do empty ones; equal rows get equal answers;
    null languages and sources are groups of their own; a ratio equal to its threshold passes. Very long texts
    are counted whole, in memory in proportion to one text. An empty table gives no rows, and further columns are ignored.
    """
    marked = _with_limits(docs, rules, prior)
    fits = F.lit(True)
    for i, r in enumerate(rules):
        fits = fits & ~_over(i, r)
    return marked.select("doc_id", "text_hash", *(n for n, _, _ in FIELDS), base_failed().alias("base_failed"), (~base_failed() & fits).alias("kept"))


def rejections(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """rule, n: documents that pass the base rules and lie outside a rule's fences."""
    marked = _with_limits(docs, rules, prior).filter(~base_failed())
    over = F.array(*(F.struct(F.lit(r.name).alias("rule"), _over(i, r).alias("out")) for i, r in enumerate(rules)))
    return marked.select(F.inline(over)).groupBy("rule").agg(F.count_if("out").alias("n"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; null and empty texts go, and equal rows share one fate."""
    out = judge(docs).filter("not kept").select("doc_id", "text_hash").distinct()
    mine = F.struct(docs["doc_id"], F.xxhash64(docs["text"]))
    return docs.join(out, mine.eqNullSafe(F.struct(out["doc_id"], out["text_hash"])), "left_anti")
