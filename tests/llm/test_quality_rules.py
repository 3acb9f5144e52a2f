"""Verdicts of the adaptive rules against exact arithmetic over all documents of a group."""

import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import quality_rules as q
from millrace.llm.texts import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, text_hash string, lo0 int"


def bucket(v):
    shift = max(v.bit_length() - 5, 0)
    return shift * 16 + (v >> shift)


def edge(b):
    shift = max(b // 16 - 1, 0)
    return (b - shift * 16) << shift


def ratios(r):
    return (
        10000 * r.n_symbols // max(r.n_words, 1),
        10000 * r.n_dup_lines // max(r.n_lines, 1),
        10000 * r.n_repeat_words // max(r.n_words, 1),
        10000 * r.n_capitals // max(r.word_chars, 1),
        100 * r.word_chars // max(r.n_words, 1),
    )


def slow_limits(rows, prior):
    """(lang, source) -> (lo, hi) of each rule, from the group's documents and ``prior`` of its language's."""
    out = {}
    by_lang, by_group = defaultdict(list), defaultdict(list)
    for lang, source, x in rows:
        by_lang[lang].append(x)
        by_group[lang, source].append(x)
    for (lang, source), own in by_group.items():
        fences = []
        for i, rule in enumerate(q.RULES):
            n, m = Counter(bucket(x[i]) for x in own), Counter(bucket(x[i]) for x in by_lang[lang])
            total = sum(m.values())
            weights = sorted((b, n[b] * total + prior * m[b]) for b in m)
            whole = sum(w for _, w in weights)

            def at(percent, weights=weights, whole=whole):
                upto = 0
                for b, w in weights:
                    upto += w
                    if upto * 100 >= whole * percent:
                        return edge(b)

            mid, top = at(50), at(rule.high)
            low = None
            if rule.low is not None:
                bottom = at(rule.low)
                low = bottom - max(rule.spread * (mid - bottom), rule.unit)
            fences.append((low, top + max(rule.spread * (top - mid), rule.unit)))
        out[lang, source] = fences
    return out


def agree(docs, prior):
    counted = q.stats(docs).collect()
    failed = lambda r: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
    limits = slow_limits([(r.lang, r.source, ratios(r)) for r in counted if not failed(r)], prior)
    want = defaultdict(set)
    for r in counted:
        good = not failed(r) and all((low is None or v >= low) and v <= high for v, (low, high) in zip(ratios(r), limits[r.lang, r.source], strict=True))
        want[r.doc_id, r.text_hash].add(good)
    got = q.judge(docs, prior=prior).collect()
    assert len(got) == len(counted)
    for r in got:
        assert r.kept in want[r.doc_id, r.text_hash] and len(want[r.doc_id, r.text_hash]) == 1
    return limits, got


def test_verdicts_of_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    limits, got = agree(docs, q.PRIOR)
    assert len({str(x) for x in limits.values()}) > 10  # thresholds differ between groups
    told = {r.rule: r.n for r in q.rejections(docs).collect()}
    assert set(told) == {r.name for r in q.RULES} and told["symbols"] > 0 and told["word_length"] > 0
    assert 0 < sum(not r.base_failed and not r.kept for r in got) < 0.15 * len(got)


@pytest.mark.parametrize("prior", [0, 1, 50])
def test_verdicts_of_odd_rows(spark, prior):
    rnd = random.Random(prior)
    rows = []
    for i in range(300):
        words = [("W" * (rnd.random() < 0.1)) + "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9 + 4 * (i % 3)))) for _ in range(rnd.randint(10, 90))]
        text = " ".join(words) + "\n" + " ".join(words[: rnd.choice([0, 0, 9])]) + "#" * rnd.choice([0, 0, 0, 0, 5, 60])
        rows.append((i, rnd.choice([text, text, text, text, None, "", text + "\nsame\nsame"]), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 0, 0, "x", 1))
    rows += rows[:20]
    rows.append((900, "long " * 2_000_000, "en", "a", 0, 0, "x", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    _, got = agree(docs, prior)
    assert {r.kept for r in got} == {True, False}
    left = q.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in q.judge(docs).collect() if r.kept)
    assert q.keep_good(docs.limit(0)).count() == 0 and q.rejections(docs.limit(0)).count() == 0


def test_a_small_group_follows_its_language(spark):
    rnd = random.Random(4)
    text = lambda capitals: " ".join(("W" if k < capitals else "w") + "".join(rnd.choices("abcdefgh", k=9)) for k in range(100))
    rows = [(i, text(rnd.randint(10, 20)), "en", "s", 0, 0, "", 0) for i in range(300)] + [(1000 + i, text(90), "en", "few", 0, 0, "", 0) for i in range(3)]
    rows += [(2000 + i, text(rnd.randint(60, 90)), "en", "many", 0, 0, "", 0) for i in range(3000)]
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame([r for r in rows if r[0] < 2000], SCHEMA)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(3))
    got = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame([(*r[:2], "de", *r[3:]) for r in rows if r[0] >= 2000] + [r for r in rows if r[0] < 300], SCHEMA)).collect()}
    assert all(got.values())
