"""A quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Document statistics are standardised and mapped to cosines of random projections, which approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the sums are added by cell,
so that the driver sees one matrix whatever the number of rows or partitions. The ridge scores of a
second fold of the labelled rows are binned, and pooled into a non-decreasing step function.

Scale: one pass over the texts writes a row of statistics each; everything after it reads these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import remainder
from millrace.llm.texts import per_row
from millrace.shared import write_table

#: Random features, ridge, kernel width in standard deviations, calibration bins, seed.
DIM, RIDGE, GAMMA, BINS, SEED = 160, 1.0, 0.08, 512, 17

STATS = ("log_words", "word_bytes", "distinct", "repeat", "squeezed", "lines", "same_lines", "capitals", "digits", "marks", "symbols", "pipes", "beyond_ascii", "stops", "short", "longest")

_CAPITALS, _DIGITS = np.zeros(256, bool), np.zeros(256, bool)
_CAPITALS[65:91] = True
_DIGITS[48:58] = True
_SYMBOLS = np.frombuffer(b"#*$%&<>{}[]=\\^~@", np.uint8)


def statistics(text: bytes) -> tuple[float, ...]:
    """STATS of a text, all finite; an empty text's are zeros."""
    words = text.split()
    n = len(words)
    if n == 0:
        return (0.0,) * len(STATS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    kinds = len(set(words))
    fours = len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / (n - 3) if n > 3 else 1.0
    lines = [s for s in text.split(b"\n") if s]
    squeezed = len(zlib.compress(text, 1)) / size
    return (
        float(np.log1p(n)),
        min(sum(map(len, words)) / n, 50.0),
        kinds / n**0.8,
        1.0 - fours,
        min(squeezed, 2.0),
        float(np.log1p(len(lines)) / np.log1p(n)),
        1.0 - len(set(lines)) / max(len(lines), 1),
        float(count[_CAPITALS].sum() / size),
        float(count[_DIGITS].sum() / size),
        float((count[33] + count[63]) / n),
        float(count[_SYMBOLS].sum() / n),
        float(count[124] / n),
        float(count[128:].sum() / size),
        float((count[46] + count[44]) / n),
        sum([len(w) <= 3 for w in words]) / n,
        float(np.log1p(max(map(len, words)))),
    )


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to ones/total by weight, by pooling neighbours; empty bins follow those before."""
    blocks: list[list[float]] = []
    for t, o in zip(total, ones, strict=True):
        blocks.append([float(t), float(o), 1])
        while len(blocks) > 1 and blocks[-1][1] * max(blocks[-2][0], 1e-12) <= blocks[-2][1] * max(blocks[-1][0], 1e-12):
            t1, o1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + o1, blocks[-1][2] + n1]
    return np.concatenate([np.full(int(n), o / t if t else 0.0) for t, o, n in blocks])


class Kernel:
    """Random cosines whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(mean), DIM - 1))
        self.b = rng.uniform(0, 2 * np.pi, DIM - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2.0 / (DIM - 1)) * np.cos(z @ self.w + self.b), np.ones(len(z))])


def _matrix(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names]) if b.num_rows else np.empty((0, len(names)))


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """The sums of f f' and f y over rows(STATS, y), f being the random features.

    A partition gives one row for each cell; cells are added as decimals, so the order of partitions
    doesn't show in the sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIM, DIM + 1))
        for b in batches:
            f = kernel(_matrix(b, STATS))
            total += f.T @ np.column_stack([f, b.column("y").to_numpy(zero_copy_only=False)])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    cells = rows.select(*STATS, F.col("y").cast("double")).mapInArrow(run, "cell int, v double")
    sums = cells.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(30,9)")).cast("double").alias("v")).toPandas()
    out = np.zeros(DIM * (DIM + 1))
    out[sums["cell"].to_numpy()] = sums["v"].to_numpy()
    out = out.reshape(DIM, DIM + 1)
    return out[:, :-1], out[:, -1]


def score_texts(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    Learns from labels.quality of all rows whose crc32 remainder isn't ``held``: four in five of them
    fit the ridge, the fifth calibrates. Scores depend on the text alone; null and empty texts
    have statistics of zero. Equal texts get equal scores. A score is 0.99 of the calibrated share plus 0.01 of the ridge's
    rank, which orders texts that calibration ties, so it is off the calibrated share by a hundredth at most. Very long texts are
    read whole, in memory in proportion to one text. Without labels every score is 0.5. An empty table gives no rows; further
    columns are ignored.
    """
    stats = write_table(per_row(docs, ["doc_id"], [(s, "double", pa.float64()) for s in STATS], lambda: statistics), "quality-statistics")
    own = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter((remainder(F.col("doc_id"), mod) != held) & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = write_table(stats.join(own, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))), "quality-labelled")
    fit, check = known.filter("fold > 0"), known.filter("fold = 0")
    m = fit.agg(*(F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)), *(F.stddev_pop(s).alias(f"s{i}") for i, s in enumerate(STATS)), F.count("*").alias("n")).first()
    held_out = (remainder(F.col("doc_id"), mod) == held).alias("held_out")
    if not m["n"]:
        return stats.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    mean = np.round([m[f"m{i}"] for i in range(len(STATS))], 9)
    scale = np.maximum(np.round([m[f"s{i}"] for i in range(len(STATS))], 9), 1e-6)
    kernel = Kernel(mean, scale)
    a, b = normal_equations(fit, kernel)
    weights = np.linalg.solve(a + RIDGE * np.eye(DIM), b)

    def ridge(rows: DataFrame, keep: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                raw = kernel(_matrix(x, STATS)) @ weights
                at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(x.column(k) for k in keep), pa.array(at)], names=[*keep, "bin"])

        kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
        return rows.select(*keep, *STATS).mapInArrow(run, f"{kinds}, bin int")

    binned = ridge(check, ["y"]).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).toPandas()
    total, ones = np.zeros(BINS), np.zeros(BINS)
    total[binned["bin"].to_numpy()], ones[binned["bin"].to_numpy()] = binned["n"].to_numpy(), binned["ones"].to_numpy()
    curve = isotonic(total, ones) if total.sum() else np.linspace(0, 1, BINS)
    # Steps of the curve tie many texts; a hundredth of the bin keeps the ridge's order within them.
    final = np.round(0.99 * curve + 0.01 * np.arange(BINS) / (BINS - 1), 9).tolist()
    score = F.element_at(F.array(*(F.lit(v) for v in final)), F.col("bin") + 1)
    return ridge(stats, ["doc_id"]).select("doc_id", held_out, score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
