import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, key int"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    """doc_id -> least doc_id reachable; fps: list of (doc_id, fp)."""
    up = {i: i for i, _ in fps}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def documents(n, seed=7):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "DELTA", "x\x1cy", "z q", "eps"] + [f"w{i}" for i in range(200)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([1, 3, 4, 30, 300]))) for _ in range(n)]
    rows = []
    for i in range(n):
        t = base[rnd.randrange(n // 3)]
        if rnd.random() < 0.6:
            t = t.replace(rnd.choice(words), "changed", 1)
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "long " * 30000)]


def test_against_brute_force(spark):
    rows = documents(150)
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(fps)
    assert {r.doc_id: r.component_id for r in got} == slow_groups(fps)


@pytest.mark.parametrize("bucket", [1, 8, 1024])
def test_links_of_dense_groups_survive_crowded_keys(spark, bucket):
    rnd = random.Random(3)
    fps = set()
    for _ in range(4):
        c = rnd.getrandbits(64)
        for _ in range(40):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), bucket=bucket).collect()
    up = {x: x for (x,) in signed}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        up[find(a)] = find(b)
    want = slow_groups(list(enumerate(fps)))
    groups = {}
    for i, (x,) in enumerate(signed):
        groups.setdefault(find(x), set()).add(want[i])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))


def test_empty_nulls_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", None, None), (5, "a b c d e", None, None), (5, "a b c d e", None, None), (3, None, None, None)]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got] == [(3, 3), (5, 5), (5, 5), (None, 5)]


def test_keep_one(spark):
    rows = [(4, "a b c d e f", None, None), (2, "a b c d e f", None, None), (2, "a b c d e f", None, None), (9, "other words stand here now", None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).select("doc_id", F.length("text")).collect()
    assert sorted(r.doc_id for r in got) == [2, 9]


def test_forest_joins_the_same_groups():
    a, b = np.array([5, 4, 9, 7]), np.array([4, 1, 8, 9])
    u, v = simhash._forest(a, b)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {4: 1, 5: 1, 8: 7, 9: 7}


@pytest.mark.parametrize("bucket, limit", [(4096, 64 << 20), (4096, 20_000), (4, 64 << 20), (2, 9_000)])
def test_similar_groups_against_shingle_sets(spark, bucket, limit):
    rnd = random.Random(9)
    vocabulary = ["w" + "".join(rnd.choices("abcdefghijk", k=5)) for _ in range(4000)]
    rows, shingles = [], {}
    for g in range(40):
        base = rnd.choices(vocabulary, k=rnd.randint(150, 400))
        for c in range(5):
            words = list(base)
            for _ in range(1 + c * len(base) // 100 // 2):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((g * 5 + c, " ".join(words), "", 0))
    for i, t, *_ in rows:
        w = t.split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA), bucket=bucket, limit=limit).collect()}
    like = [(a, b) for a in shingles for b in shingles if b < a and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8]
    assert len(like) > 100
    assert np.mean([got[a] == got[b] for a, b in like]) >= 0.97
    assert all(i // 5 == c // 5 for i, c in got.items())


def test_only_exact_similarity_links(spark):
    """Pairs at about 0.7, which 256 bits can't tell from 0.8, stay apart; those at 0.85 don't."""
    rnd = random.Random(12)
    vocabulary = ["w" + "".join(rnd.choices("abcdefghijk", k=5)) for _ in range(4000)]
    rows, words = [], {}
    for g in range(60):
        base = rnd.choices(vocabulary, k=200)
        changed = list(base)
        # Each changed word, far from others, takes five of 196 shingles.
        for k in range(7 if g % 2 else 3):
            changed[10 + 20 * k] = "changed%d" % rnd.randrange(10**6)
        for c, w in enumerate((base, changed)):
            words[2 * g + c] = w
            rows.append((2 * g + c, " ".join(w), "", 0))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    for g in range(60):
        a, b = 2 * g, 2 * g + 1
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert (0.68 < alike < 0.75) if g % 2 else alike > 0.82
        assert (got[a] == got[b]) == (g % 2 == 0)


def test_keep_one_of_each_group_whatever_its_doc_ids(spark):
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(8)]
    rows = [(None, t, None, None) for t in texts[:4]] + [(None, texts[0], None, None)]
    rows += [(7, texts[4], None, None), (7, texts[5], None, None), (7, texts[5], None, None)]
    rows += [(None, texts[6], None, None), (3, texts[6], None, None)]
    rows += [(8, texts[7], None, None), (7, texts[7], None, None)]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (3, texts[6]), (7, texts[7])]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 30_000, 6_000])
def test_blocks_of_a_component_link_as_all_pairs_do(spark, limit):
    rnd = random.Random(limit)
    rows, sets = [], {}
    for c in range(3):
        base = rnd.sample(range(1, 10**9), 120)
        for i in range(60):
            own = list(base)
            for _ in range(rnd.choice([0, 2, 6, 9, 14, 30])):
                own[rnd.randrange(120)] = rnd.randrange(1, 10**9)
            h = c * 1000 + i
            sets[h] = set(own)
            rows.append((c, h, bytearray(32), bytearray(np.array(sorted(sets[h]), np.uint64).tobytes())))
    table = simhash.write_table(spark.createDataFrame(rows, "component bigint, h bigint, bits binary, shingles binary"), "test-sets")
    found = simhash._verified_links(table, 64, limit)[0].collect()
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    def groups(pairs):
        up = {h: h for h in sets}

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return {h: find(h) for h in sets}

    want = groups([(a, b) for a in sets for b in sets if a < b and a // 1000 == b // 1000 and near(a, b)])
    assert groups([tuple(r) for r in found]) == want and len(set(want.values())) > 20
