"""The operators that are DataFrame functions only: mixing, URL rules, license scans."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, mixing, url_rules

DOCS = "doc_id bigint, text string, source string, size string, row int"


def test_mixing_against_a_plain_loop(spark):
    sizes = {"b": [5, 7, 100], "a": [1], "é": [40, 40, 0], None: [9], "zz": [300]}
    rows = [(i, " ".join(["w\x1cx"] * n) if n else None, s, "clash", 1) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    rows.append(rows[0])
    got = mixing.plan(spark.createDataFrame(rows, DOCS)).collect()
    total = {}
    for _, t, s, *_ in rows:
        total[s] = total.get(s, 0) + len((t or "").split(" ") if t else [])
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, left, goal = set(order), 1.5 * sum(total.values()), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] <= level * weight[s]}
        if not full:
            break
        goal |= {s: 2.0 * total[s] for s in full}
        left, free = left - sum(2 * total[s] for s in full), free - full
    goal |= {s: level * weight[s] for s in free}
    source = {i: s for i, _, s, *_ in rows}
    assert len(got) == len(rows) and abs(sum(goal.values()) - 1.5 * sum(total.values())) < 1e-6
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(goal[s]), s
        rate = goal[s] / total[s]
        u = int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:13], 16) / 16**13
        assert r.copies == int(rate) + (u < rate - int(rate))


def test_mix_emits_copies_with_the_columns(spark):
    rows = [(i, "a b c", "s" if i % 2 else "t", None, i) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df)
    assert out.columns == df.columns
    n = {r.doc_id: r.copies for r in mixing.plan(df).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in n.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0


URLS = [
    "https://www.example.com/en/1", "https://m.example.com/en/2", "HTTP://WWW.Example.COM/EN/3", "https://xexample.com/en/", "http://a.net/es/x", "http://net/fr/", "http://anet.org/fr/",
    "https://com", "https://com/", "no scheme", "", None, "http://x.com:80/en/?a=http://y/z#t", "http://x.net?q/es/", "a://b.com#/en/", "x\n://www.example.com/en/\n", "http://m.adult-x.example.org/en/5", "http://adult-x.example.org/de/7?utm_source=f", "https://good.example.org/de/7",
]


def slow_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_url_rules(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS * 3)]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, tokens string")).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        h, p, rule, verdict = slow_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, rule), u
        assert got[i].verdict == verdict or rule is None and got[i].verdict in ("allow", "block"), u
        assert rule or got[i].verdict == "block" or "adult" not in h


def test_url_rules_mined_as_by_counting(spark):
    rows = [(["label:a", "part:a", "tld:x"], True)] * 6 + [(["label:b", "tld:x"], False)] * 5 + [(["in:q", "label:b", "tld:y"], True)] * 4 + [(["in:q", "tld:z"], False)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = {tuple(r.tokens) for r in url_rules.mine(labelled, 0.1, 0.95, 1).collect()}
    assert rules == {("label:a",), ("tld:y",), ("in:q", "label:b")}
    sets = spark.createDataFrame([(["in:q", "label:b", "tld:w"],), (["in:q", "tld:w"],), (["tld:y"],), ([],)], "tokens array<string>")
    got = {tuple(r.tokens) for r in url_rules.match(sets, url_rules.mine(labelled, 0.1, 0.95, 1)).collect()}
    assert got == {("in:q", "label:b", "tld:w"), ("tld:y",)}


def slow_verdicts(urls, tokens, support, confidence, few):
    """Of the URLs without a base rule: whether some set of their tokens is nearly always bad, by trying all sets."""
    bad = [slow_url(u)[3] == "block" or any(f"host:{p}" in t for p in url_rules.BLOCKED_PARTS) for u, t in zip(urls, tokens, strict=True)]
    own = [i for i, u in enumerate(urls) if slow_url(u)[2] is None]
    count, hit = {}, {}
    for t, b in zip(tokens, bad, strict=True):
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                count[c] = count.get(c, 0) + 1
                hit[c] = hit.get(c, 0) + b
    least = max(support * sum(map(bool, tokens)), few)
    rules = {c for c, n in hit.items() if n >= least and n >= confidence * count[c]}
    return {i: "block" if any(c in rules for k in range(1, len(tokens[i]) + 1) for c in itertools.combinations(sorted(tokens[i]), k)) else "allow" for i in own}


def test_verdicts_against_all_token_sets(spark):
    rnd = random.Random(3)
    urls = []
    for _ in range(700):
        host = rnd.choice(["", "m.", "www."]) + rnd.choice(["casino-win", "win-big", "big-shop", "shop", "news", "ads-x"]) + rnd.choice([".example", ""]) + rnd.choice([".com", ".net", ".org"])
        urls.append(f"https://{host}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.choice(['a', 'b', '12'])}" + rnd.choice(["", "?ref=x", "?page=2&ref=y", "#top", ".html"]))
    rows = [(i, u, "clash", "x") for i, u in enumerate(urls + [None, "", "none"])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, tokens string")
    cut = pages.select("page_id", "url", url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path"))
    tokens = {r.page_id: list(r.t) if r.host else [] for r in cut.select("page_id", "host", url_rules.tokens().alias("t")).collect()}
    for support, confidence, least in ((0.001, 0.95, 1), (0.02, 0.8, 1), (0.001, 0.95, 10)):
        got = {r.page_id: r.verdict for r in url_rules.judge(pages, support=support, confidence=confidence, least=least).collect()}
        want = slow_verdicts(urls, [tokens[i] for i in range(len(urls))], support, confidence, least)
        assert want and all(got[i] == v for i, v in want.items())
        assert {"allow", "block"} == set(want.values())
    # Whole domains aren't blocked for what base rules say of two of their paths.
    plain = [i for i in want if ".net/de" in urls[i] and "shop." in urls[i] and "big" not in urls[i]]
    assert plain and all(got[i] == "allow" for i in plain)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "http://b.org/x", None, None)]])
def test_url_rules_without_labels(spark, rows):
    got = url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, tokens string")).collect()
    assert [r.verdict for r in got] == ["allow"] * len(rows)


TEXTS = [
    "Released under the MIT License.", "mit-license MIT  License mit license", "cc by-nc 4.0 cc by cc by", "GNU General Public\nLicense and Apache License", "gnu general public licence", "", None, "mİt license", "miT liKense", "ümit license", "mit license license",
    "Licensed under the Apache License, Version 2.0.", "x " * 20000 + "MIT license", "license " * 3000, "Redistribution and use in source and binary forms, with or without modification, are permitted", "permission slip for software",
    "This work is licensed under the GNU General Public License, version 3.",
]


def slow_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rows = [(i, t, None, "clash", 1) for i, t in enumerate(TEXTS + TEXTS)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_license(t), repr(t)[:60]
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    more = {i: set(got[i].labels.split(",")) for i in range(len(TEXTS))}
    assert "apache-2.0" in more[11] and "bsd" in more[14] and "gpl-3.0" in more[16] and more[2] == {"cc-by"}
    assert more[13] == {""} and more[15] == {""} and got[13].score == 0
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def slow_placements(texts):
    """labels and score by comparing every window of every file with every template."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in texts]
    index = {w for _, notice, _ in licenses.TEMPLATES for w in notice.split()} - licenses.COMMON
    df = {w: sum(w in set(x) for x in split) for w in index}
    idf = {w: round(math.log((len(texts) + 1) / (df[w] or 0.5)), 6) for w in index}
    out = []
    for own in split:
        best = {}
        for label, notice, phrase in licenses.TEMPLATES:
            places, key = notice.split(), phrase.split()
            at = next(i for i in range(len(places)) if places[i : i + len(key)] == key)
            mass = sum(idf[w] for w in places if w in index)
            lined, whole = {}, {}
            for i, w in enumerate(places):
                for p in [p for p, x in enumerate(own) if x == w and w in index]:
                    for window in ((p - i) // licenses.DRIFT, (p - i) // licenses.DRIFT + 1):
                        lined.setdefault(window, {})[i] = idf[w]
            for p in range(len(own) - len(key) + 1):
                if own[p : p + len(key)] == key:
                    for window in ((p - at) // licenses.DRIFT, (p - at) // licenses.DRIFT + 1):
                        whole[window] = True
            for window, found in lined.items():
                if window in whole and sum(found.values()) >= licenses.SHARE * mass - 1e-9:
                    best[label] = max(best.get(label, 0), sum(found.values()) / mass)
        base = {label for p, label in licenses.BASE if f" {p} " in f" {' '.join(own)} "}
        out.append((",".join(sorted(base | set(best))), 1.0 if base else round(max(best.values(), default=0), 5)))
    return out


def test_labels_and_scores_against_every_window(spark):
    apache = "licensed under the apache license version 2 0"
    notices = [n for _, n, _ in licenses.TEMPLATES]
    texts = [*notices, *(n.replace(" ", "\n ", 3) + " and more" for n in notices)]
    # Phrases without a notice, notices whose phrase is broken, and notices with words left out or put in.
    texts += ["we read about the apache license version 2 0 last week", apache.replace("apache", "apache very"), "source code form mozilla public license", "permission is hereby granted free of charge", "x " * 50 + notices[-1], None, "", "public domain"]
    texts += ["other text"] * 1500
    rnd = random.Random(8)
    for n in notices:
        words = n.split()
        for _ in range(3):
            w = list(words)
            for _ in range(rnd.randint(1, max(1, len(w) // 6))):
                w.pop(rnd.randrange(len(w)))
            for _ in range(rnd.randint(0, 3)):
                w.insert(rnd.randrange(len(w) + 1), "other")
            texts.append(" ".join(rnd.choices(words, k=4) + w + rnd.choices(words, k=4)))
    rows = [(i, t, None, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, round(r.score, 5)) for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    want = slow_placements(texts)
    for i, t in enumerate(texts):
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) <= 2e-5, (t, got[i], want[i])
    n = len(notices) * 2
    assert all("apache-2.0" not in got[n + k][0].split(",") for k in (0, 1)) and got[n + 2][0] == got[n + 3][0] == ""


def test_every_license_of_a_file_is_found(spark):
    mixed = "this source code form and its documentation files are free software any person may obtain a copy with or without modification see conditions. licensed under the GNU General Public License version 3"
    three = [(" some words between ".join(t[1] for t in c), {t[0] for t in c}) for c in itertools.combinations(licenses.TEXTS, 3)]
    assert len(three) == 84
    files = [*three, (" ".join(t[1] for t in licenses.TEMPLATES), {t[0] for t in licenses.TEMPLATES}), (mixed, {"gpl-3.0"})]
    # Other files make the IDFs differ.
    rows = [(i, t, None, "", 1) for i, (t, _) in enumerate(files)] + [(1000 + i, "gnu general public license version", None, "", 1) for i in range(200)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (t, labels) in enumerate(files):
        assert labels <= got[i], (t[:80], labels - got[i])
        assert got[i] <= labels | {label for _, label in licenses.BASE}


def test_key_phrases_stand_in_their_templates():
    for w, t, place, need in licenses.postings():
        assert licenses.TEMPLATES[t][1].split()[place] == w and len((need or "").split()) <= licenses.AFTER
    for label, notice, phrase in licenses.TEMPLATES:
        assert f" {phrase} " in f" {notice} " and phrase.split()[0] not in licenses.COMMON, label
