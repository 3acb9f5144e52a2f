"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

A lexicon is learned from labelled rows: words whose presence speaks for the label, with their log
odds. Every token of every text is matched against it. A token that isn't in it may be a misspelling:
its Levenshtein automaton (one insertion, deletion, substitution or swap) is run along the trie.
Around each match a window of tokens decides whether the word is aimed at someone or quoted. The sums of
both kinds, a few densities, and how loud a text is (capitals, exclamation marks, words said twice) are the features of a
logistic model that gives the score.

Scale: the lexicon and the model are learned from a bounded number of labelled rows (``FIT_ROWS``) and sent to all tasks
because of that bound: the lexicon has no more words than those rows. Scoring is one pass without an exchange.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import remainder, training
from millrace.llm.texts import per_row
from millrace.shared import write_table

#: Labelled rows that are learned from.
FIT_ROWS = 20_000
#: A word's support in labelled texts, its least log odds, and the length from which any token may be a misspelling
#: of it; of a shorter word (three letters at least), only tokens that no clean labelled text has.
SUPPORT, ODDS, FUZZY = 4, 1.5, 5
#: The share of toxic texts that makes a word a core word, and what a misspelling of one counts of its odds, for labelled texts
#: have too few to learn it; tokens that a clean labelled text has are none. Other words' misspellings the model weighs apart.
FREQUENT, MISSPELT = 0.05, 0.8
#: Tokens to either side that make a match's context, and entries of a task's cache.
CONTEXT, CACHED = 5, 300_000

#: Words that report someone else's, and words that address someone.
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word words phrase reported slur insult sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split())
ADDRESSING = frozenset("you your you're youre u ur du dich dein deine ihr euch tu te toi ton vous votre tú ti usted tus".split())
OPEN, CLOSE = "\"'“‘«„‹(", "\"'”’»“›)"
#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")

_CAPITALS = bytes(range(65, 91))
_LETTERS = re.compile(r"[^\W\d_]+")


class Trie:
    """The lexicon as nested dictionaries; the key "" holds a word's number."""

    def __init__(self, words: list[str], known: frozenset[str] = frozenset(), core: frozenset[str] = frozenset()) -> None:
        self.root: dict = {}
        self.known = known
        self.guarded = {i for i, w in enumerate(words) if len(w) < FUZZY or w in core}
        self.number = {w: i for i, w in enumerate(words)}
        # Words one edit apart share a form with at most one letter left out; all others needn't be run.
        self.forms: set[str] = set()
        for w, i in self.number.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = i
            self.forms.add(w)
            self.forms.update([w[:k] + w[k + 1 :] for k in range(len(w))])
        self.least, self.most = max(min(map(len, words), default=0) - 1, 2), max(map(len, words), default=0) + 1

    def near(self, word: str) -> int | None:
        """The number of a lexicon word within one edit of ``word``, the least such; None if there is none."""
        n = len(word)
        if not self.least <= n <= self.most:
            return None
        forms = self.forms
        if word not in forms and forms.isdisjoint([word[:k] + word[k + 1 :] for k in range(n)]):
            return None
        barred = self.guarded if word in self.known else ()
        best: int | None = None
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        end, whole = 1 << n, (2 << n) - 1
        # The automaton's states as bits: letters of the word read without an edit, with one, and with a swap half done.
        stack = [(self.root, 1, 2, 0)]
        while stack:
            node, plain, edited, swap = stack.pop()
            if "" in node and (plain | edited) & end and node[""] not in barred and (best is None or node[""] < best):
                best = node[""]
            for c, child in node.items():
                if c:
                    here = at.get(c, 0)
                    read = (plain & here) << 1
                    # Read; a letter more; another letter; the swap's second letter; a letter less.
                    after = ((edited & here) << 1 | plain | plain << 1 | (swap & here) << 2 | read << 1) & whole
                    half = plain & here >> 1
                    if read or after or half:
                        stack.append((child, read, after, half))
        return best


@dataclass(frozen=True)
class Lexicon:
    words: list[str]
    odds: list[float]
    #: Words of clean labelled texts that could be taken for misspellings of short or core words.
    known: frozenset[str] = frozenset()
    core: frozenset[str] = frozenset()


def learn_lexicon(docs: DataFrame, sample: DataFrame) -> Lexicon:
    """Words of sampled texts with the label's odds. Equal texts count once, with either label."""
    rows = docs.join(F.broadcast(sample), "doc_id").filter("text is not null")
    texts = rows.select("y", "text", F.xxhash64("text").alias("family")).dropDuplicates(["y", "family"])
    words = texts.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = words.filter(F.length("word") >= 2).groupBy("word").agg(F.count(F.when(F.col("y") == 1, 1)).alias("t"), F.count(F.when(F.col("y") == 0, 1)).alias("n"))
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    t_all, n_all = sizes.get(1, 0) + 1.0, sizes.get(0, 0) + 1.0
    odds = F.log((F.col("t") + 0.5) / t_all) - F.log((F.col("n") + 0.5) / n_all)
    best = counts.filter((F.length("word") >= 3) & (F.col("t") >= SUPPORT)).withColumn("odds", F.round(odds, 4)).filter(F.col("odds") >= ODDS)
    rows = best.orderBy(F.desc(F.col("t") * F.col("odds")), "word").collect()
    core = frozenset(r["word"] for r in rows if r["t"] >= FREQUENT * t_all)
    near = sorted(set().union(*({w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for w in core)))
    own = F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.col("word").substr(F.lit(1), k - 1), F.col("word").substr(k + 1, F.length("word")))))
    alike = F.lit(False) if not near else (F.length("word") <= max(map(len, near)) + 1) & F.arrays_overlap(own, F.array(*map(F.lit, near)))
    known = counts.filter((F.col("n") > 0) & ((F.length("word") <= FUZZY) | alike)).select("word").collect()
    return Lexicon([r["word"] for r in rows], [float(r["odds"]) for r in rows], frozenset(r["word"] for r in known), core)


FEATURES = ("aimed", "quoted", "misspelt", "kinds", "density", "dense_window", "addressed", "capitals", "marks", "echo")


class Matcher:
    """Features of one text: FEATURES in order."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.odds, self.trie = lexicon.odds, Trie(lexicon.words, lexicon.known, lexicon.core)
        self.core = {i for i, w in enumerate(lexicon.words) if w in lexicon.core}
        self.cache: dict[str, int] = {}

    def code(self, token: str) -> int:
        """0: nothing; n + 1: lexicon word n; -(n + 1): a misspelling of it."""
        number = self.trie.number
        if (n := number.get(token)) is not None:
            return n + 1
        parts = _LETTERS.findall(token)
        for p in parts:
            if (n := number.get(p)) is not None:
                return n + 1
        plain = "".join(_LETTERS.findall(token.translate(LEET))) if len(parts) != 1 or len(parts[0]) < len(token) - 2 else parts[0]
        if plain and (n := number.get(plain)) is not None:
            return -(n + 1)
        n = self.trie.near(plain)
        return 0 if n is None else -(n + 1)

    def features(self, text: bytes) -> tuple[float, ...]:
        tokens = text.decode("utf-8", "replace").lower().split()
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        for t in set(tokens).difference(cache):
            cache[t] = self.code(t)
        codes = [cache[t] for t in tokens]
        size = max(len(tokens), 1)
        loud = ((len(text) - len(text.translate(None, _CAPITALS))) / max(len(text), 1), min(text.count(b"!") / size, 1.0), sum(map(eq, tokens, tokens[1:])) / size)
        hits = [i for i, c in enumerate(codes) if c]
        if not hits:
            return (*(0.0,) * (len(FEATURES) - len(loud)), *loud)
        aimed: dict[int, float] = {}
        quoted: dict[int, float] = {}
        misspelt: dict[int, float] = {}
        addressed, meant = 0, []
        for i in hits:
            c = codes[i]
            n = abs(c) - 1
            before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
            if _is_quoted(before, tokens[i], after):
                quoted[n] = self.odds[n]
                continue
            meant.append(i)
            addressed += not ADDRESSING.isdisjoint(before) or not ADDRESSING.isdisjoint(after)
            if c > 0:
                aimed[n] = self.odds[n]
            elif n in self.core:
                aimed.setdefault(n, MISSPELT * self.odds[n])
            else:
                misspelt[n] = self.odds[n]
        at = np.array(meant, np.int64)
        dense = int((np.searchsorted(at, at + 2 * CONTEXT) - np.arange(len(at))).max(initial=0))
        return (sum(aimed.values()), sum(quoted.values()), sum(misspelt.values()), float(len(aimed)), min(len(meant) / size, 1.0), float(min(dense, 10)), min(addressed / max(len(meant), 1), 1.0), *loud)


def _is_quoted(before: list[str], token: str, after: list[str]) -> bool:
    """Whether a mark opens before the token and closes after it, or a reporting word stands close by."""
    opened = token[0] in OPEN or any(t[0] in OPEN and t[-1] not in CLOSE for t in before)
    closed = token.rstrip(".,;:!?")[-1:] in tuple(CLOSE) or any(t.rstrip(".,;:!?")[-1:] in tuple(CLOSE) for t in after)
    return opened and closed or not REPORTING.isdisjoint(before[-3:])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[list[float], float]:
    """Weights and intercept by Newton's method with a ridge on standardised features; a constant if labels are all alike."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        return [0.0] * x.shape[1], float(np.log(p / (1 - p)))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * (p * (1 - p) + 1e-9) @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    weights = w[:-1] / scale
    return weights.tolist(), float(w[-1] - weights @ mean)


def score_texts(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the features: a row for each row of docs.

    Learns from labels.toxic of rows whose crc32 remainder isn't ``held``; scores whole texts by
    their words alone. Null and empty texts have no match and get the score that goes with none.
    Equal texts get equal scores. Words of equal weight are ordered by their letters, rows of the sample by the hash of their
    doc_id. Very long texts are read whole, in memory in proportion to one text. Without labels the score is a constant near 0;
    an empty table gives no rows; further columns are ignored.
    """
    sample = write_table(training(labels, "toxic", remainder(F.col("doc_id"), mod) != held, fit_rows), "toxic-sample")
    lexicon = learn_lexicon(docs.select("doc_id", "text"), sample)

    def make():
        return Matcher(lexicon).features

    found = write_table(per_row(docs, ["doc_id"], [(f, "double", pa.float64()) for f in FEATURES], make), "toxic-features")
    rows = found.join(F.broadcast(sample), "doc_id").select("y", *FEATURES).toPandas()
    rows = rows.sort_values(list(rows.columns))
    weights, bias = fit_logistic(rows[list(FEATURES)].to_numpy(np.float64), rows["y"].to_numpy(np.float64))
    logit = F.lit(bias)
    for f, w in zip(FEATURES, weights, strict=True):
        logit = logit + F.lit(w) * F.col(f)
    score = F.round(1 / (1 + F.exp(-logit)), 9)
    out = found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.select("doc_id", (remainder(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)
