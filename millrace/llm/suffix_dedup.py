"""Repeated passages by suffix order and longest previous factors, over all texts at once.

A string of ``length`` bytes that occurs twice is found however the corpus is dealt out:

1. Anchors. The least hash of the short grams within a window of ``length`` bytes depends on the window's bytes
   only, so equal windows have equal anchors. Consecutive windows with the same anchor form a run,
   about one for 85 bytes; only runs are exchanged. An anchor that one run has cannot repeat.
2. Whole runs. Runs with equal hashes of all their bytes are copies of each other; one stands for all.
3. Factors. What is left are different runs with the same anchor: the edges of repeated passages. Their
   bytes are fetched and their suffixes put in order, with the common prefixes of neighbours; the previous and next
   smaller positions in that order give the longest factor that occurs earlier (or, with signs
   turned, later). Where it is ``length`` bytes or more, all its bytes are a repeat.

An anchor with many different runs is dealt out in blocks. A block names one window for each of its
classes, and a second exchange on a 128-bit hash of these windows joins the blocks. Copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.texts import fresh, small_batches, utf8
from millrace.shared import write_table

#: Bytes of an anchor's gram, of text hashed at a time, and of runs whose suffixes are ordered at a time.
GRAM, CHUNK, SORTED = 32, 1 << 19, 1 << 20
#: Different runs of an anchor above which it is dealt out in blocks of about this size.
BLOCK = 2048

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = _U((1 << 64) * 8 // 100)


class _Hash:
    """Sums of byte values times powers of an odd base, modulo 2**64: any window's hash from two prefix sums."""

    def __init__(self, most: int) -> None:
        self.value = np.array([xxhash.xxh64_intdigest(bytes([b]), 1) for b in range(256)], _U)
        self.up, self.down = np.ones(most + 1, _U), np.ones(most + 1, _U)
        self.up[1:], self.down[1:] = _U(_BASE), _U(pow(_BASE, -1, 1 << 64))
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(30))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours: prefix minima of blocks from both sides."""
    n = len(h)
    full = np.full(-(-n // width) * width, ~_U(0), _U)
    full[:n] = h
    rows = full.reshape(-1, width)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def runs_of(text: bytes, length: int, hashes: _Hash) -> tuple[np.ndarray, ...]:
    """anchor, run hash, first window start, number of windows, and whether the anchor's gram occurs again within the run."""
    width = length - GRAM + 1
    chunk = len(hashes.up) - 1 - length
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(text) - length + 1, 0), chunk):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, chunk + length - 1), at)
        p = hashes.prefix(data)
        n = len(data)
        h = _mix((p[GRAM:] - p[: n - GRAM + 1]) * hashes.down[: n - GRAM + 1])
        low = _least(h, width)
        start = np.concatenate([[0], np.nonzero(low[1:] != low[:-1])[0] + 1])
        count = np.diff(np.append(start, len(low)))
        end = start + count - 1 + length
        anchor = low[start]
        whole = _mix((p[end] - p[start]) * hashes.down[start] + count.astype(_U) * _U(0xD6E8FEB86659FD93))
        small = np.nonzero(h < _LOW)[0]
        a, b = np.searchsorted(small, start), np.searchsorted(small, start + count - 1 + width)
        size = b - a
        owner = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        again = np.bincount(owner[h[small[place]] == anchor[owner]], minlength=len(start))
        found.append((anchor, whole, start + at, count, (again > 1) | (anchor >= _LOW)))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none, none.astype(bool)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash(CHUNK + length)
        for b in batches:
            parts, rows = [], []
            for i, t in enumerate(b.column(2)):
                if len(t := t.as_buffer()) >= length:
                    parts.append(runs_of(t, length, hashes))
                    rows.append((i, len(parts[-1][0])))
            if not parts:
                continue
            anchor, whole, start, count, again = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(np.repeat([r[0] for r in rows], [r[1] for r in rows]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0).take(take),
                    "h": b.column(1).take(take),
                    "anchor": pa.array(anchor.view(np.int64)),
                    "whole": pa.array(whole.view(np.int64)),
                    "start": pa.array(start.astype(np.int64)),
                    "count": pa.array(count.astype(np.int32)),
                    "again": pa.array(again),
                }
            )

    return run


def suffix_levels(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """Numbers that order all suffixes by their first 1, 2, 4, 8, ... symbols, until all differ or ``most`` symbols are compared.

    ``data`` holds numbers below 512; past its end, symbols count as the least.
    """
    n = len(data)
    one = data.astype(np.int64)
    after = lambda x, h: np.append(x[h:], np.zeros(min(h, n), np.int64))
    two = one << 9 | after(one, 1)
    rank = np.unique(two << 18 | after(two, 2), return_inverse=True)[1].astype(np.int64)
    levels, h = [(1, one.astype(np.int32)), (2, two.astype(np.int32)), (4, rank.astype(np.int32))], 4
    while h < most and n and rank.max() + 1 < n:
        rank = np.unique(rank * (n + 2) + after(rank + 1, h), return_inverse=True)[1].astype(np.int64)
        h *= 2
        levels.append((h, rank.astype(np.int32)))
    return levels


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes a and b share, ``most`` of them at the most: level by level from the widest."""
    out = np.zeros(len(a), np.int64)
    n = len(levels[0][1])
    for h, rank in reversed(levels):
        at = np.nonzero((np.maximum(a, b) + out < n) & (out < most))[0]
        same = at[rank[a[at] + out[at]] == rank[b[at] + out[at]]]
        out[same] += h
    return np.minimum(out, most)


def longest_previous(order: np.ndarray, shared: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each entry of a suffix order, the longest factor that also starts at a smaller place.

    ``shared[i]`` is the common prefix of entries i-1 and i, ``place`` what decides earlier and later.
    The longest is reached at the previous or the next smaller place in suffix order (the common
    prefix only shrinks on the way), so both are found by jumping over larger ones.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    for side in (1, -1):
        near = place[order][::side]
        lcp = shared if side == 1 else np.append(shared[1:], 0)[::-1]
        to, upto = np.arange(n) - 1, lcp.copy()
        open_ = np.nonzero((to >= 0) & (upto > 0))[0]
        while len(open_):
            open_ = open_[near[to[open_]] >= near[open_]]
            step = to[open_]
            upto[open_] = np.minimum(upto[open_], upto[step])
            to[open_] = to[step]
            gone = to[open_] < 0
            upto[open_[gone]] = 0
            open_ = open_[~gone & (upto[open_] > 0)]
        upto[(to < 0) | (upto <= 0)] = 0
        best = np.maximum(best, upto[::side])
    return best


def _repeats(pieces: list[bytes], counts: np.ndarray, length: int, first: bool) -> tuple[np.ndarray, ...]:
    """Of all windows of the pieces: piece, offset, the longest factor that stands elsewhere too (0 below ``length``), and whether it stands earlier. Pieces are in order of place."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(size + 1) - size - 1
    # A zero ends each piece, so that a suffix that ends sorts before all that go on.
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 1
    data[begin + size] = 0
    levels = suffix_levels(data, int(size.max()))
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[piece] + offset
    order = np.argsort(levels[-1][1][at], kind="stable")
    left = size[piece] - offset
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    shared[1:] = common_prefix(levels, at[a], at[b], np.minimum(left[a], left[b]))
    # Shorter factors decide nothing, and chains of them needn't be followed.
    shared[shared < length] = 0
    place = np.arange(len(order))
    factor = np.zeros(len(order), np.int64)
    factor[order] = longest_previous(order, shared, place)
    earlier = factor >= length
    if not first:
        later = np.zeros(len(order), np.int64)
        later[order] = longest_previous(order, shared, -place)
        factor = np.maximum(factor, later)
    return piece, offset, factor, earlier


def _spans(piece: np.ndarray, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors, in order, joined to spans: piece, begin, end."""
    if not len(piece):
        return piece, offset, offset
    end = np.maximum.accumulate((piece.astype(np.int64) << 40) + offset + size) & ((1 << 40) - 1)
    cut = np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] > end[:-1])])
    first = np.nonzero(cut)[0]
    last = np.append(first[1:], len(piece)) - 1
    return piece[first], offset[first], end[last]


def _factors(length: int, first: bool):
    """Sorted (anchor, block, doc_id, h, start, count, split, bytes) in; spans and, for split anchors, windows out."""
    names = ["doc_id", "h", "begin", "end", "window"]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # Rows that repeat doc_id and text bring their pieces again, next to each other.
        ids = [rows.column(c).combine_chunks() for c in ("anchor", "h", "start", "doc_id")]
        own = np.ones(rows.num_rows, bool)
        own[1:] = np.logical_or.reduce([~pc.fill_null(pc.equal(c[1:], c[:-1]), c.null_count > 0).to_numpy(zero_copy_only=False) for c in ids])
        rows = rows.filter(pa.array(own))
        # Several anchors and blocks are solved together, in the order that says which copy is first.
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "h", "start")], null_placement="at_start"))
        pieces = rows.column("bytes").to_pylist()
        start = rows.column("start").to_numpy()
        piece, offset, factor, earlier = _repeats(pieces, rows.column("count").to_numpy(), length, first)
        twice = factor >= length
        at, begin, end = _spans(piece[twice], offset[twice], factor[twice])
        split = rows.column("split").to_numpy()
        named = np.nonzero(split[piece] & ~earlier)[0]
        words = [xxhash.xxh3_128_digest(pieces[p][o : o + length]) for p, o in zip(piece[named].tolist(), offset[named].tolist(), strict=True)]
        for own, a, b, w in ((at, begin, end, [None] * len(at)), (piece[named], offset[named], offset[named] + length, words)):
            if len(own):
                take = pa.array(own)
                doc, h = rows.column("doc_id").combine_chunks().take(take), rows.column("h").combine_chunks().take(take)
                yield pa.RecordBatch.from_arrays([doc, h, pa.array(a + start[own]), pa.array(b + start[own]), pa.array(w, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in (x.slice(i, n) for x in batches for n in [max(1, x.num_rows * SORTED // (2 * max(x.nbytes, 1)))] for i in range(0, x.num_rows, n)):
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.nbytes < SORTED:
                continue
            anchor, block = held.column("anchor").to_numpy(), held.column("block").to_numpy()
            same = np.nonzero((anchor != anchor[-1]) | (block != block[-1]))[0]
            cut = same[-1] + 1 if len(same) else 0
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held)

    return run


def _cut_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, runs = b.column(2), b.column(3)
            flat = runs.flatten()
            owner = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            start, count = flat.field("start").to_numpy(zero_copy_only=False), flat.field("count").to_numpy(zero_copy_only=False)
            whole = [t.as_buffer() for t in text]
            cut = [whole[i][s : s + c - 1 + length].to_pybytes() for i, s, c in zip(owner.tolist(), start.tolist(), count.tolist(), strict=True)]
            take = pa.array(owner)
            yield pa.RecordBatch.from_pydict(
                {"anchor": flat.field("anchor"), "block": flat.field("block"), "doc_id": b.column(0).take(take), "h": b.column(1).take(take), "start": flat.field("start"), "count": flat.field("count"), "split": flat.field("split"), "bytes": pa.array(cut, pa.binary())}
            )

    return run


def repeated_spans(keyed: DataFrame, length: int = 200, first: bool = False, block: int = BLOCK) -> DataFrame:
    """keyed(doc_id, h, text as bytes) -> doc_id, h, spans: array of begin * 2**32 + end.

    With ``first``, the earliest copy by (doc_id, h, place) is left out, else every copy is listed.
    """
    kind = keyed.schema["doc_id"].dataType.simpleString()
    runs = write_table(keyed.mapInArrow(_find_runs(length), f"doc_id {kind}, h bigint, anchor bigint, whole bigint, start bigint, count int, again boolean"), "runs")
    often = runs.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.max("again").alias("again_"))
    often = often.filter("n > 1").select("anchor", (F.col("again_") | (F.col("lo") != F.col("hi"))).alias("mixed"))
    seen = write_table(runs.join(often, "anchor"), "repeated-runs")
    row = F.struct("doc_id", "h", "start", "count")
    classes = write_table(seen.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(row).alias("one"), F.max("mixed").alias("mixed")), "run-classes")

    copies = seen.join(classes.filter("n > 1").select("anchor", "whole", "one"), ["anchor", "whole"])
    if first:
        copies = copies.filter(~row.eqNullSafe(F.col("one")))
    spans = copies.select("doc_id", "h", F.col("start").alias("begin"), (F.col("start") + F.col("count") - 1 + length).alias("end"))

    edges = classes.filter("mixed").select("anchor", "one.*")
    many = edges.groupBy("anchor").count().filter(F.col("count") > 2 * block).select("anchor", F.ceil(F.col("count") / block).alias("blocks"))
    edges = edges.join(many, "anchor", "left").withColumn("split", F.col("blocks").isNotNull())
    edges = edges.withColumn("block", F.when(F.col("split"), F.pmod(F.xxhash64("doc_id", "h", "start"), F.col("blocks"))).otherwise(0).cast("int"))
    of_doc = edges.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "block", "start", "count", "split")).alias("runs"))
    fetched = keyed.join(of_doc.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "runs"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    piece_schema = f"anchor bigint, block int, doc_id {kind}, h bigint, start bigint, count int, split boolean, bytes binary"
    pieces = fetched.select("doc_id", "h", "text", "runs").mapInArrow(_cut_pieces(length), piece_schema)
    pieces = pieces.repartition("anchor", "block").sortWithinPartitions("anchor", "block", "doc_id", "h", "start")
    factors = write_table(pieces.mapInArrow(_factors(length, first), f"doc_id {kind}, h bigint, begin bigint, end bigint, window binary"), "factors")

    named = factors.filter("window is not null")
    across = named.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "begin")).alias("least")).filter("n > 1")
    met = named.join(across.select("window", "least"), "window")
    if first:
        met = met.filter(~F.struct("doc_id", "h", "begin").eqNullSafe(F.col("least")))
    spans = spans.union(factors.filter("window is null").drop("window")).union(met.select("doc_id", "h", "begin", "end"))
    packed = F.shiftleft(F.col("begin"), 32).bitwiseOR(F.col("end")).alias("s")
    return spans.groupBy("doc_id", "h").agg(F.collect_list(packed).alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Packed spans as maximal (begin, end), touching ones joined."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    begin, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    cut = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.nonzero(cut)[0]
    return list(zip(begin[at].tolist(), end[np.append(at[1:], len(spans)) - 1].tolist(), strict=True))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, removed, cuts, rest = [], [], [], []
        lists = b.column(3)
        for i, t in enumerate(b.column(2).to_pylist()):
            spans = merged(lists[i].values.to_numpy(zero_copy_only=False)) if lists[i].is_valid else []
            n.append(len(t))
            removed.append(sum(e - a for a, e in spans))
            cuts.append(len(spans))
            ends = [0, *(e for _, e in spans)]
            rest.append(b"".join(t[a:e] for a, e in zip(ends, [*(a for a, _ in spans), len(t)], strict=True)) if spans else t)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "h": b.column(1), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(cuts, pa.int64()), "rest": pa.array(rest, pa.binary())})


def remove_repeats(docs: DataFrame, length: int = 200, first: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, rest (bytes): a row for each row of docs.

    Every byte that a repeated string of ``length`` bytes covers is removed; with ``first`` the
    earliest copy stays, by doc_id and place. Null texts are empty, and texts shorter than ``length``
    stay whole. Rows that repeat doc_id and text are copies of each other (with ``first`` they share
    one fate). Very long texts are hashed in chunks; one text and its spans are in memory at a time. An
    empty table gives no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), utf8(F.col("text")).alias("text"))
    spans = repeated_spans(keyed, length, first, block)
    spans = spans.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "spans")
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return joined.select("doc_id", "h", "text", "spans").mapInArrow(_remove, f"doc_id {kind}, h bigint, n_bytes bigint, n_removed bigint, n_spans bigint, rest binary")



@F.pandas_udf(StringType())
def _rest(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(t: bytes, own: np.ndarray | None) -> str | None:
        if own is None:
            return None
        found = merged(np.asarray(own))
        ends = [0, *(e for _, e in found)]
        return b"".join(t[a:e] for a, e in zip(ends, [*(a for a, _ in found), len(t)], strict=True)).decode("utf-8", "ignore")

    return pd.Series([cut(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def drop_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs with the later copies of repeated passages cut out of their texts; the first copy stays.

    Characters that a cut goes through are dropped whole. n_chars, where docs has it, is counted anew.
    Rows whose texts have no repeat are unchanged, and a null text stays null.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), utf8(F.col("text")).alias("text"))
    d, h, own = (fresh(docs, n) for n in ("doc", "hash", "spans"))
    spans = repeated_spans(keyed, length, first=True).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("spans").alias(own))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans[d]) & (F.xxhash64(docs["text"]) == spans[h]), "left")
    out = joined.withColumn("text", F.coalesce(_rest(utf8(F.col("text")), F.col(own)), F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
