import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import labels, quality_model, toxicity
from millrace.llm.texts import table

DOCS = "doc_id bigint, text string, aimed string, score double"
LABELS = "doc_id bigint, quality int, toxic int, y int"


def one_edit(a, b):
    """Whether a becomes b by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    made = {a[:i] + a[i + 1 :] for i in range(len(a))}
    made |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in set(b)}
    made |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)}
    made |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in made


def test_automaton_against_all_edits():
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(5, 8))) for _ in range(30)})
    trie = toxicity.Trie(words)
    seen = 0
    for _ in range(3000):
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(w))
            rnd.choice([lambda: w.__setitem__(i, rnd.choice("abc")), lambda: w.insert(i, rnd.choice("abc")), lambda: w.pop(i), lambda: w.__setitem__(slice(i, i + 2), w[i : i + 2][::-1])])()
        w = "".join(w)
        want = [i for i, x in enumerate(words) if one_edit(x, w)]
        if len(w) >= toxicity.FUZZY - 1:
            assert trie.near(w) == (min(want) if want else None), w
            seen += bool(want)
    assert seen > 1000


def test_context_and_spelling():
    m = toxicity.Matcher(toxicity.Lexicon(["idiot", "moron"], [4.0, 3.0]))
    f = lambda t: dict(zip(toxicity.FEATURES, m.features(t.encode()), strict=True))
    assert f("you idiot!")["aimed"] == 4 and f("you idiot!")["addressed"] == 1
    assert f('they called him an "idiot" again')["quoted"] == 4 and f("the word idiot is old")["aimed"] == 0
    assert f("such an idoit")["misspelt"] == 4 and f("M0ron")["misspelt"] == 3 and f("idiots")["misspelt"] == 4
    assert set(f("an innocent line").values()) == set(f("").values()) == {0.0}


def test_core_words_count_though_misspelt():
    m = toxicity.Matcher(toxicity.Lexicon(["idiot", "fragment"], [4.0, 2.0], frozenset(["idiom"]), frozenset(["idiot"])))
    f = lambda t: dict(zip(toxicity.FEATURES, m.features(t.encode()), strict=True))
    assert f("such an idoit")["aimed"] == 4 * toxicity.MISSPELT and f("such an idoit")["misspelt"] == 0
    assert f("idiot idoit idiot")["aimed"] == 4 and f("a fragmet")["misspelt"] == 2 and f("an idiom")["aimed"] == 0
    loud = f("AB ab ab!")
    assert (loud["capitals"], loud["marks"], loud["echo"]) == (2 / 9, 1 / 3, 1 / 3)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return table(spark, d, "documents"), table(spark, d, "labels")


@pytest.mark.parametrize("score, label, mod, held", [(toxicity.score_texts, "toxic", 3, 1), (quality_model.score_texts, "quality", 5, 0)])
def test_held_out_rows(spark, tables, score, label, mod, held):
    docs, marks = tables
    got = score(docs, marks).join(marks, "doc_id").select("doc_id", "held_out", "score", "predicted", label).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % mod == held for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all()
    out = got[got["held_out"]]
    good, bad = out[out[label] == 1]["score"].to_numpy(), out[out[label] == 0]["score"].to_numpy()
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.9
    # Turning the held-out labels round changes nothing.
    turned = marks.withColumn(label, F.when(labels.remainder(F.col("doc_id"), mod) == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = score(docs, turned).select("doc_id", F.col("score").alias("s")).toPandas()
    both = got.merge(again, on="doc_id")
    assert np.allclose(both["score"], both["s"], atol=1e-6)


def test_quoting_lowers_scores_of_real_rows_and_misspelling_keeps_them(spark, tables):
    docs, marks = tables
    toxic = docs.join(marks.filter("toxic = 1"), "doc_id").select("doc_id", "text").collect()
    sample = labels.training(marks, "toxic", labels.remainder(F.col("doc_id"), 3) != 1, toxicity.FIT_ROWS)
    lexicon = toxicity.learn_lexicon(docs.select("doc_id", "text"), sample)
    core = [w for w in lexicon.words[:10] if len(w) >= toxicity.FUZZY]
    assert len(core) >= 5
    rows, kinds = [], ("plain", "quoted", "misspelt")
    for r in toxic:
        quoted, wrong = r.text, r.text
        for w in core:
            quoted = re.sub(rf"(?i)\b({w})\b", r'he said "\1" there', quoted)
            wrong = re.sub(rf"(?i)\b({w})\b", lambda m: m[1][:2] + m[1][3:], wrong)
        if quoted != r.text:
            rows += [(10**6 + 3 * r.doc_id + k, t) for k, t in enumerate((r.text, quoted, wrong))]
    assert len(rows) > 60
    got = toxicity.score_texts(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string")), marks).filter("doc_id >= 1000000").toPandas()
    by = {k: got[(got["doc_id"] - 10**6) % 3 == i].sort_values("doc_id")["score"].to_numpy() for i, k in enumerate(kinds)}
    assert (by["plain"] > by["quoted"]).mean() > 0.9 and by["plain"].mean() - by["quoted"].mean() > 0.3
    # Misspellings count nearly as much as the words.
    assert by["plain"].mean() - by["misspelt"].mean() < 0.25


def test_quality_scores_by_plain_arithmetic(spark, tables):
    docs, marks = tables
    rows = docs.join(marks, "doc_id", "left").select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")).collect()
    x = {r.doc_id: np.array(quality_model.statistics((r.text or "").encode())) for r in rows}
    learn = [r for r in rows if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    fit, check = [r for r in learn if r.fold], [r for r in learn if not r.fold]
    at = np.array([x[r.doc_id] for r in fit])
    kernel = quality_model.Kernel(at.mean(0), np.maximum(at.std(0), 1e-6))
    f, y = kernel(at), np.array([r.quality for r in fit])
    weights = np.linalg.solve(f.T @ f + quality_model.RIDGE * np.eye(quality_model.DIM), f.T @ y)
    bins = quality_model.BINS
    place = lambda own: int(np.clip(np.floor((kernel(own[None]) @ weights + 0.5) / 2 * bins), 0, bins - 1)[0])
    total, ones = np.zeros(bins), np.zeros(bins)
    for r in check:
        total[place(x[r.doc_id])] += 1
        ones[place(x[r.doc_id])] += r.quality
    full = np.nonzero(total)[0]
    share = lambda a, b: ones[full[a : b + 1]].sum() / total[full[a : b + 1]].sum()
    curve, last = np.zeros(bins), 0.0
    for b in range(bins):
        if b in full:
            i = list(full).index(b)
            last = max(min(share(j, k) for k in range(i, len(full))) for j in range(i + 1))
        curve[b] = last
    got = {r.doc_id: r.score for r in quality_model.score_texts(docs, marks).collect()}
    want = {i: 0.99 * curve[place(v)] + 0.01 * place(v) / (bins - 1) for i, v in x.items()}
    near = sum(abs(got[i] - v) < 1e-6 for i, v in want.items())
    assert near >= 0.995 * len(want)  # a text on a bin's edge may fall to either side


@pytest.mark.parametrize("score", [toxicity.score_texts, quality_model.score_texts])
def test_odd_rows(spark, score):
    marks = spark.createDataFrame([(i, i % 2, i % 2, 9) for i in range(60)] + [(None, 1, 1, 1), (3, None, None, None), (4, 1, 1, 1)], LABELS)
    rows = [(i, ("vile words here " if i % 2 else "kind words there ") * 9, "x", 0.1) for i in range(60)] + [(None, "vile words", None, None), (100, None, None, None), (101, "", None, None), (5, "w " * 50000, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = score(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert {r.score for r in got if r.doc_id == 100} == {r.score for r in got if r.doc_id == 101}
    assert score(df.limit(0), marks).count() == 0
    assert score(df, marks.limit(0)).count() == len(rows)


def test_isotonic_is_the_best_monotone_fit():
    total, ones = np.array([4.0, 0, 2, 2, 1, 5]), np.array([1.0, 0, 2, 0, 1, 4])
    fit = quality_model.isotonic(total, ones)
    assert (np.diff(fit) >= 0).all()
    assert fit.tolist() == pytest.approx([0.25, 0.25, 0.5, 0.5, 5 / 6, 5 / 6])


def test_normal_equations(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, len(quality_model.STATS))), rng.integers(0, 2, 50)
    kernel = quality_model.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], [*quality_model.STATS, "y"]).repartition(3)
    a, b = quality_model.normal_equations(rows, kernel)
    f = kernel(x)
    assert np.allclose(a, f.T @ f, atol=1e-6) and np.allclose(b, f.T @ y, atol=1e-6)


def test_short_words_are_misspelt_too(spark):
    m = toxicity.Matcher(toxicity.Lexicon(["scum", "moron"], [4.0, 3.0], frozenset({"scam", "sum"})))
    f = lambda t: m.features(t.encode())[toxicity.FEATURES.index("misspelt")]
    assert [f(t) for t in ("scumm", "sccum", "scmu", "scm", "scim", "mroon")] == [4, 4, 4, 4, 4, 3]
    assert [f(t) for t in ("scam", "sum", "sc", "scuffs")] == [0, 0, 0, 0]


def test_texts_with_a_common_header_count_each(spark):
    head = "the same header stands before every text of this source and is long "
    rows = [(i, head + f"scum t{i}") for i in range(6)] + [(10 + i, head + f"fine {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sample = spark.createDataFrame([(i, int(i < 10)) for i, _ in rows], "doc_id bigint, y int")
    assert toxicity.learn_lexicon(docs, sample).words == ["scum"]
