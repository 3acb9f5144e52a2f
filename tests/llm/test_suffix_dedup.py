import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, anchor string, n_chars bigint"


def slow(texts, length, first):
    """Bytes left and runs removed of each text, by a table of all strings of ``length`` bytes."""
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((i, s))
    out = []
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            at = seen[t[s : s + length]]
            if len(at) > 1 and not (first and at[0] == (i, s)):
                gone[s : s + length] = b"\1" * length
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((rest, sum(gone), sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))))
    return out


def corpus(seed=2):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgé", k=rnd.randint(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared = [para(60) for _ in range(5)]
    out = []
    for _ in range(70):
        parts = [para(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 3))]
        for _ in range(rnd.randint(0, 2)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, 100)
            parts.insert(rnd.randrange(len(parts) + 1), s[a : a + rnd.choice([150, 199, 230, 400])])
        out.append(" ".join(parts))
    out += [out[3], out[3], out[4] + "tail", "xyz " * 150, "a" * 700, "a" * 199, shared[0][:200], shared[0], "", "é" * 300, shared[1] + " " + shared[1]]
    return out


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("block", [1, 2048])
def test_against_brute_force(spark, first, block):
    texts = corpus()
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(len(texts), None, None, None)]
    got = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), 200, first, block).collect()}
    want = slow([t.encode() for t in texts] + [b""], 200, first)
    for i, (rest, n, spans) in enumerate(want):
        r = got[i]
        assert (bytes(r.rest), r.n_removed, r.n_spans, r.n_bytes) == (rest, n, spans, len(rest) + n), i


def test_chunks_of_a_long_text_and_repeated_rows(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choices("abcd", k=1500))
    text = (long + "!" + long[400:900]).encode()
    a, w, s, c, again = sd.runs_of(text, 200, sd._Hash(300 + 200))
    assert int(c.sum()) == len(text) - 199 and (np.diff(s) == c[:-1]).all()
    rows = [(1, long, None, 1), (1, long, None, 1), (2, "short", None, 5)]
    got = sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1500), (1, 1500), (2, 0)]
    kept = sorted((r.doc_id, r.n_removed) for r in sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), first=True).collect())
    assert kept == [(1, 0), (1, 0), (2, 0)]


def test_longest_previous_factors():
    data = np.frombuffer(b"abababcabcab", np.uint8)
    n = len(data)
    order = np.array(sorted(range(n), key=lambda i: bytes(data[i:])))
    common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or data[i + k] != data[j + k]), n)
    shared = np.array([0, *(common(order[i - 1], order[i]) for i in range(1, n))])
    got = np.empty(n, int)
    got[order] = sd.longest_previous(order, shared, np.arange(n))
    assert got.tolist() == [max([0, *(common(i, j) for j in range(i))]) for i in range(n)]


def test_factors_of_pieces_against_all_pairs():
    rnd = random.Random(5)
    for case in range(40):
        base = bytes(rnd.choices(b"ab\0" if case % 2 else b"abcdefgh", k=60))
        pieces = [base[a : a + rnd.randint(12, 40)] + bytes(rnd.choices(b"abc", k=rnd.randint(0, 20))) for a in (rnd.randrange(40) for _ in range(rnd.randint(1, 6)))]
        pieces = [p if len(p) >= 8 else p + b"x" * 8 for p in pieces]
        length = 8
        counts = np.array([len(p) - length + 1 for p in pieces])
        piece, offset, factor, earlier = sd._repeats(pieces, counts, length, first=False)
        _, _, before, _ = sd._repeats(pieces, counts, length, first=True)
        suffixes = [pieces[p][o:] for p, o in zip(piece.tolist(), offset.tolist(), strict=True)]

        def common(a, b):
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            return n if n >= length else 0

        for i, own in enumerate(suffixes):
            assert factor[i] == max([0, *(common(own, x) for j, x in enumerate(suffixes) if j != i)])
            assert before[i] == max([0, *(common(own, x) for x in suffixes[:i])]) and earlier[i] == (before[i] >= length)


def test_drop_repeats_keeps_columns_and_first_copies(spark):
    p = "".join(random.Random(4).choices("klmnop", k=300))
    rows = [(1, "one " + p, "x", 304), (2, p + " two", "y", 304), (3, "three", None, 5), (None, None, None, None)]
    got = {r.doc_id: r for r in sd.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == "one " + p and got[2].text == " two" and got[2].n_chars == 4 and got[2].anchor == "y"
    assert got[3].text == "three" and got[None].text is None
    assert sd.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
