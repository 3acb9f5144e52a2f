"""License scans by a positional index of rare words, with DataFrame functions only.

A template's words are postings (word, template, place), weighed by their IDF over the corpus. A placement needs
``SHARE`` of its template's weight, so it holds one at least of the rarest words that make up the rest: a file's
words are looked up among those first. For the templates found so, all the file's words are looked up, and
postings that agree on file position minus place line up as one placement. Where enough of the weight stands in
line, the template's mandatory key phrase must stand there word for word, at one shift.

Scale: one pass over the texts writes a narrow table; only files with an index word give rows beyond
their own, at most as many as they have such words. Templates are a constant of this module, so the
broadcast of their postings has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.shared import write_table

#: Everything that isn't a digit, a lower-case letter or beyond ASCII parts words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the base scan: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, name as one-line notices carry it, which is the key phrase.
NAMES = (
    ("apache-2.0", "apache license version 2 0"),
    ("bsd-2", "bsd 2 clause license"),
    ("bsd-3", "bsd 3 clause license"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-3.0", "gnu general public license v3"),
    ("lgpl", "gnu lesser general public license"),
    ("mit-notice", "mit license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
)
VERBS = ("licensed under the", "licensed under", "released under the", "distributed under the")
#: Label, text in words as files carry it, mandatory key phrase in it.
TEXTS = (
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or "
        "at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    (
        "mit-terms",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "permission is hereby granted free of charge",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "released into the public domain"),
)
TEMPLATES = (*((label, f"{verb} {name}", name) for label, name in NAMES for verb in VERBS), *TEXTS)
#: Words that aren't indexed, for every text has them; a key phrase's are compared as what follows an indexed word.
COMMON = frozenset("a and any are as at by if in into is it may no not of on one or see that the this to was with you your for be but do so all an 0 2 3 4 v".split())
#: The share of a template's weight a placement needs, how far it may shift for inserted words, and words kept after an indexed one.
SHARE, DRIFT, AFTER = 0.8, 4, 4


def postings() -> list[tuple[str, int, int, str | None]]:
    """word, template, place, and for words of the key phrase those that follow up to the next indexed one."""
    out = []
    for t, (_, notice, phrase) in enumerate(TEMPLATES):
        own, key = notice.split(), phrase.split()
        at = next(i for i in range(len(own)) if own[i : i + len(key)] == key)
        for i, w in enumerate(own):
            if w in COMMON:
                continue
            need = None
            if at <= i < at + len(key):
                rest = own[i + 1 : at + len(key)]
                stop = next((k for k, x in enumerate(rest) if x not in COMMON), len(rest))
                need = " ".join(["", *rest[:stop]])
            out.append((w, t, i, need))
    return out


def words(text: Column) -> Column:
    """The words of the text with A-Z lowered, joined by single spaces.

    lower() also changes letters beyond ASCII, which makes no word of a phrase and no word's end:
    the only one that becomes ASCII is the Kelvin sign, and it is put back first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    return F.trim(F.regexp_replace(plain, BREAK, " "))


def _has(norm: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {phrase} ")


def _starts(words_: Column, phrase: str) -> Column:
    """Indices at which the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words_, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            found = found & (F.get(words_, i + k) == w)
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words_) - len(parts)), here)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_words, n_base, first_word, last_word, base (labels), found: array of (word, position, what follows)."""
    norm = docs.select("doc_id", words(F.col("text")).alias("norm"))
    split = norm.withColumn("words", F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.split("norm", " ")))
    none = F.array().cast("array<int>")
    at = [F.when(_has(F.col("norm"), p), _starts(F.col("words"), p)).otherwise(none) for p, _ in BASE]
    places = F.concat(*(F.col(f"p{i}") for i in range(len(BASE))))
    index = sorted({p[0] for p in postings()})
    any_word = F.arrays_overlap("words", F.array(*(F.lit(w) for w in index)))
    pairs = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(index))
    found = F.transform(pairs, lambda x: F.struct(x["word"].alias("word"), x["pos"].alias("pos"), F.concat(F.lit(" "), F.array_join(F.slice("words", x["pos"] + 2, AFTER), " "), F.lit(" ")).alias("after")))
    empty = F.array().cast("array<struct<word:string,pos:int,after:string>>")
    base = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)))))
    return split.withColumns({f"p{i}": a for i, a in enumerate(at)}).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        base.alias("base"),
        F.when(any_word, found).otherwise(empty).alias("found"),
    )


def placements(scanned: DataFrame) -> DataFrame:
    """row, template, score: verified placements; score is the best one's share of the template's IDF weight."""
    spark = scanned.sparkSession
    total = scanned.count()
    hits = scanned.filter(F.size("found") > 0).select("row", F.inline("found"))
    by_word = hits.groupBy("row", "word").agg(F.count("*").alias("times"))
    # As many rows as the index has words, a constant.
    often = by_word.groupBy("word").agg(F.count("*").alias("df"))
    constant = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(i).alias("place"), F.lit(need).cast("string").alias("need")) for w, t, i, need in postings()))
    index = spark.range(1).select(F.inline(constant)).join(often, "word", "left")
    weight = F.round(F.log(F.lit(float(total + 1)) / F.coalesce("df", F.lit(0.5))), 6).cast("decimal(20,6)")
    whole = W.partitionBy("template")
    index = index.withColumn("idf", weight).withColumn("mass", F.sum("idf").over(whole))
    # The rarest words, until what is left can't make up a placement.
    before = F.coalesce(F.sum("idf").over(whole.orderBy(F.desc("idf"), "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    index = write_table(index.withColumn("probe", before <= F.col("mass") * (1 - SHARE)), "license-index")
    probes = F.broadcast(index.filter("probe").select("word", "template").distinct())
    candidates = by_word.select("row", "word").join(probes, "word").select("row", "template").distinct()
    placed = hits.join(candidates.groupBy("row").agg(F.collect_set("template").alias("templates")), "row").join(F.broadcast(index), "word").filter(F.array_contains("templates", F.col("template")))
    placed = write_table(placed.select("row", "template", "place", "mass", "idf", (F.col("pos") - F.col("place")).alias("shift"), "need", "after"), "license-placed")
    window = F.floor(F.col("shift") / DRIFT)
    near = placed.withColumn("window", F.explode(F.array(window, window + 1)))
    aligned = near.groupBy("row", "template", "mass", "window", "place").agg(F.max("idf").alias("idf"))
    lined = aligned.groupBy("row", "template", "mass", "window").agg(F.sum("idf").alias("own")).filter(F.col("own") >= F.col("mass") * SHARE)
    wanted = index.filter("need is not null").groupBy("template").agg(F.count("*").alias("words"))
    phrase = placed.filter(F.col("need").isNotNull() & F.col("after").startswith(F.concat("need", F.lit(" ")))).groupBy("row", "template", "shift").agg(F.countDistinct("place").alias("words"))
    window = F.floor(F.col("shift") / DRIFT)
    verified = phrase.join(F.broadcast(wanted), ["template", "words"]).withColumn("window", F.explode(F.array(window, window + 1))).select("row", "template", "window").distinct()
    found = lined.join(verified, ["row", "template", "window"])
    return found.groupBy("row", "template").agg(F.max(F.col("own").cast("double") / F.greatest(F.col("mass").cast("double"), F.lit(1e-6))).alias("score"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs.

    Base labels are the phrases that stand in the text, score 1; the method adds the labels of its
    verified placements, with their best score. Null and empty texts have no words, null positions,
    empty labels and score 0. Repeated rows give equal rows; an empty table gives none; further
    columns are ignored. Very long texts are scanned whole, in memory in proportion to one text.
    """
    scanned = write_table(scan(docs), "license-scan")
    names = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    added = placements(scanned).groupBy("row").agg(F.collect_set(F.element_at(names, F.col("template") + 1)).alias("more"), F.max("score").alias("best"))
    all_labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return scanned.join(added, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), F.round(F.least(score, F.lit(1.0)), 6).alias("score")
    )
