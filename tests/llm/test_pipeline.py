import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from millrace.llm import bpe, mixing, quality_rules, suffix_dedup  # noqa: E402
from millrace.llm.texts import table  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint"


def slow_counts(text):
    words = (text or "").encode().split()
    n = len(words)
    again = [False] * n
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                again[i : i + 8] = [True] * 8
    lines = [s for s in (text or "").split("\n") if s.encode().split()]
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(again)


def documents():
    rnd = random.Random(6)
    words = [f"wörd{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(60)]
    texts += [texts[0] + "\n" + texts[0], "a b c d e f g h " * 9, "x# " * 40, "same line\nsame line\n\n \nsame line", None, "", "\x1c\x85 y", "\n".join(["l one two", "l one two"] * 30), "p " * 8, "p " * 9]
    return [(i, t, rnd.choice(["en", None]), rnd.choice(["s", "t", None]), len(t or ""), 0) for i, t in enumerate(texts)]


def test_counts_and_base_rules(spark):
    rows = documents()
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        want = slow_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)[:80]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_buckets(spark):
    df = spark.range(0, 5000).withColumn("b", quality_rules.bucket(quality_rules.F.col("id"))).withColumn("edge", quality_rules.lower_edge(quality_rules.F.col("b")))
    rows = df.collect()
    least = {}
    for r in rows:
        least.setdefault(r.b, r.id)
    assert all(r.edge == least[r.b] and r.id - r.edge <= r.edge / 16 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_thresholds_follow_groups(spark):
    rnd = random.Random(2)
    plain = [(i, " ".join(f"w{rnd.randrange(999)}" for _ in range(50)), "en", "plain", 0, 0) for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{rnd.randrange(999)}" + "#" * (rnd.random() < 0.4 + i % 5 / 10) for _ in range(50)), "en", "code", 0, 0) for i in range(300)]
    odd = (5000, " ".join(f"w{i}##" for i in range(50)), "en", "plain", 0, 0)
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame([*plain, *noisy, odd], SCHEMA)).collect()}
    assert all(got[i] for i, *_ in plain) and not got[5000]
    assert sum(got[i] for i, *_ in noisy) >= 295


def test_stages_one_by_one(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "mixing", "byte_bpe"]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out = cp.write_table(out, "test")
        before, after = docs.count(), out.count()
        assert after > 0 and (name == "mixing" or after <= before)
        docs = out
    final = cp.run(spark, sf)
    assert final.count() == docs.count()


def test_each_stage_does_what_its_operator_says(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in cp.quality(spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    cut = {r.doc_id: r.text for r in cp.passages(spark, docs, sf).collect()}
    rest = {r.doc_id: bytes(r.rest).decode("utf-8", "ignore") for r in suffix_dedup.remove_repeats(docs, first=True).collect()}
    assert cut == rest and any(cut[i] != rows[i] for i in rows)
    taken = {}
    for r in cp.mix(spark, docs, sf).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {r.doc_id: r.copies for r in mixing.plan(docs).collect() if r.copies}
    assert bpe.__name__ and cp.encode(spark, docs, sf).count() == len(rows)


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, hash string, times string, copy string, spans string, h bigint, text_hash string, component bigint, key string"


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    rnd = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choices(words, k=60)), "en", "s", 60, "x", None, "1", "c", "p", 1, "t", 2, "k") for i in range(30)]
    rows += [rows[0], rows[0], (None, rows[1][1] + " end", None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (77, "", "", "", 0, *[None] * 9), (78, "long " + " ".join(rnd.choices(words, k=60_000)), "en", "s", 0, *[None] * 9)]
    docs = spark.createDataFrame(rows, CLASH)
    for some in (docs, docs.limit(0)):
        out = stage(spark, some, "")
        if name != "byte_bpe":
            assert out.columns == docs.columns
        n = out.count()
        assert n == 0 if some is not docs else n > 20
