"""Near-duplicate groups by 64-bit SimHash with deletion-variant signatures.

Two fingerprints that differ in at most 4 of 64 bits, cut into 3 segments (21, 21 and 22 bits),
differ by at most one bit in at least one segment, for three segments of two bits each would make 6.
Each distinct fingerprint is therefore indexed under its segments with one bit struck out: 64 keys.
Two segments that differ by at most one bit share a key, so an equality exchange on the key brings
every pair together, and the full distance verifies it.

Scale: exact copies collapse to one fingerprint before anything is exchanged. A key's members are
compared in a streamed, sorted partition. A key with more than ``bucket`` members (some 10**9 different
fingerprints fill all keys so) is cut once more in the same way: the bits outside its segment, in three segments of 14
or 15 bits, give 43 variants, so that 33 bits are equal in place of 20. What is still crowded then, many fingerprints
around one, meets in the middle. Fingerprints within 4 bits share a point within 2 bits of both, and any two that share
such a point are within 4 bits, so linking each to the least fingerprint at each of its 2,081 points joins the same
groups with a cost in proportion to the members, whatever their number. All three ways are exact, and a
fingerprint takes the first that its key's size allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.texts import fresh, per_row, small_batches
from millrace.operators.components import connected_components
from millrace.shared import write_table

BITS, SEED = 64, 42
#: (lowest bit, width) of the segments, for a distance of up to 4.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SLOT = 22


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bits of XXH64 (seed 42) over the shingles of the A-Z-lowered text; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), a row for each row of docs."""

    def make():
        return lambda t: (v - (1 << 64) if (v := fingerprint(t, shingle)) >= 1 << 63 else v,)

    return per_row(docs, ["doc_id"], [("fp", "bigint", pa.int64())], make)


def _variants(fp):
    keys = []
    for lo, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        keys += [part.bitwiseAND(F.lit(~(1 << j))) + F.lit((len(keys) + j) << SLOT) for j in range(width)]
    return F.array(*keys)


#: (lowest bit, width) of the segments into which the 43 bits outside a key's own segment are cut.
REST = ((0, 14), (14, 14), (28, 15))


def _rest_variants(key, fp):
    """Keys of a member of the crowded key: its number and value, and a second variant from the bits outside its segment."""
    table = F.shiftrightunsigned(key, SLOT) % BITS
    rest = None
    for (lo, width), last in zip(SEGMENTS, (21, 42, 64), strict=True):
        own = fp.bitwiseAND(F.lit((1 << lo) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, lo + width), lo) if lo + width < BITS else F.lit(0))
        rest = F.when(table < last, own) if rest is None else rest.when(table < last, own)
    keys = []
    for lo, width in REST:
        part = F.shiftrightunsigned(rest, lo).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << j))) + F.lit((len(keys) + j) << 15) for j in range(width)]
    return F.transform(F.array(*keys), lambda k: F.shiftleft(key.cast("bigint"), 21) + k)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group that the links a-b join: (member, least member)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pairs(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the runs of equal keys, one comparison distance at a time."""
    left, right = [], []
    at = np.nonzero(key[1:] == key[:-1])[0]
    d = 1
    while len(at):
        near = np.bitwise_count((fp[at] ^ fp[at + d]).view(np.uint64)) <= most
        left.append(fp[at[near]])
        right.append(fp[at[near] + d])
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _verify(most: int, bucket: int):
    """Sorted (key, fp) in; (a, b, null) links out, or (a, null, key) for a member of a crowded key."""

    def emit(a, b, key=None):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(a) if key is None else key, pa.int64())], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, crowded = np.empty(0, np.int32), np.empty(0, np.int64), None
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            yield from settle(key, fp, crowded, last=False)
            tail = np.searchsorted(key, key[-1]) if len(key) else 0
            if len(key) - tail > bucket or (len(key) and crowded == key[-1]):
                crowded = key[-1]
                held_key, held_fp = key[:0], fp[:0]
                yield emit(fp[tail:], [None] * (len(fp) - tail), key[tail:])
            else:
                held_key, held_fp = key[tail:], fp[tail:]
        yield from settle(held_key, held_fp, crowded, last=True)

    def settle(key, fp, crowded, last):
        """The runs that are complete: all, or all but the last."""
        if not len(key):
            return
        end = len(key) if last else np.searchsorted(key, key[-1])
        key, fp = key[:end], fp[:end]
        if not end:
            return
        first = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.nonzero(first)[0], end))
        size = np.repeat(size, size)
        many = (size > bucket) | (key == crowded if crowded is not None else False)
        if many.any():
            yield emit(fp[many], [None] * int(many.sum()), key[many])
        few = (size > 1) & ~many
        a, b = _forest(*_pairs(key[few], fp[few], most))
        if len(a):
            yield emit(a, b)

    return run


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << i for i in range(BITS)]
    masks = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 64):
            part = fp[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part, len(masks)))], names=["point", "fp"])


#: Members of a key that are compared with each other in one task.
BUCKET = 4096


def _compared(keyed: DataFrame, most: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """keyed(key, fp) -> links (a, b), and what is left: (key, fp) of crowded keys."""
    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")
    found = write_table(ordered.mapInArrow(_verify(most, bucket), "a bigint, b bigint, key bigint").distinct(), "links")
    return found.filter("key is null").select("a", "b"), found.filter("key is not null").select("key", F.col("a").alias("fp"))


def links(fps: DataFrame, max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Distinct fps(fp) -> (a, b): links that join the same groups as all pairs within 4 bits do.

    Not every pair is listed: within a key, a group is given as a star around its least member.
    """
    if max_bits != 4:
        raise ValueError("the three segments are complete for a distance of exactly up to 4 bits")
    small_batches(fps.sparkSession)
    sure, crowd = _compared(fps.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp"), max_bits, bucket)
    if crowd.isEmpty():
        return sure
    more, crowd = _compared(crowd.select(F.explode(_rest_variants(F.col("key"), F.col("fp"))).alias("key"), "fp"), max_bits, bucket)
    sure = sure.union(more)
    if crowd.isEmpty():
        return sure
    met = write_table(crowd.select("fp").distinct().mapInArrow(_points, "point bigint, fp bigint"), "points")
    least = met.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top").drop("top")
    return sure.union(met.join(least, "point").filter("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links of at most ``max_bits`` bits.

    One row for each row of docs. Null or wordless texts have fingerprint zero, linked like any other.
    Repeated rows share a group. A null doc_id is never a group's name unless all of its group are
    null. Very long texts are hashed whole, in memory in proportion to one text. An empty table gives no rows; further
    columns, whatever their names, are ignored.
    """
    signed = write_table(fingerprints(docs, shingle), "fingerprints")
    distinct = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = write_table(links(distinct.select("fp"), max_bits, bucket), "links")
    groups = connected_components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = of.join(named, "component").select("fp", "component_id")
    return signed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: The least Jaccard similarity of near-duplicates, as a fraction of their five-word shingles.
SIMILAR = (4, 5)
#: Bits by which two 256-bit fingerprints of the shingle sets may differ for the sets to be compared at all:
#: 39 are expected at 0.8 (cosine 0.89), 6 is their deviation, so 64 leaves out hardly any such pair.
SIMILAR_BITS = 64
_LANES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _grams(one: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the different runs of n words (of all words if they are fewer), sorted."""
    n = min(n, len(one))
    out = np.zeros(len(one) - n + 1, np.uint64)
    for k in range(n):
        out = _scatter(out * np.uint64(0x9FB21C651E98DF25) + one[k : len(one) - n + 1 + k])
    return np.unique(out)


def _words(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SEED) for w in text.lower().split()], np.uint64)


def shingle_set(text: bytes) -> bytes:
    """The text's different five-word shingles as sorted 64-bit hashes; no word: none."""
    one = _words(text)
    return _grams(one, 5).tobytes() if len(one) else b""


def sketch(text: bytes) -> tuple[int, int, bytes]:
    """Fingerprints of a text's different words, of its word pairs, and 256 bits of its set of five-word shingles."""
    one = _words(text)
    if not len(one):
        return 0, 0, bytes(32)
    five = _grams(one, 5)
    return _majority(np.unique(one)), _majority(_grams(one, 2)), b"".join(_majority(_scatter(five ^ lane)).to_bytes(8, "little", signed=True) for lane in _LANES)


def _similar(most: int, bucket: int):
    """Sorted (key, h, bits) in; links (u, v, null) out that join each key's members as all close pairs would, or (h, null, key) for a member of a crowded key."""

    def solve(h: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(h)
        label = np.arange(n)
        a, b = [], []
        outside = np.arange(n)
        for i in range(n - 1):
            # Only members of other groups can add a link; in a dense group hardly any are left.
            outside = outside[(outside > i)]
            other = outside[label[outside] != label[i]]
            if not len(other):
                if (label == label[i]).all():
                    break
                continue
            near = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= most]
            if len(near):
                a += [h[i]] * len(near)
                b += h[near].tolist()
                label[np.isin(label, label[near])] = label[i]
        return np.array(a, np.int64), np.array(b, np.int64)

    def emit(u, v, key=None):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([None] * len(u) if v is None else v, pa.int64()), pa.array([None] * len(u) if key is None else key, pa.int64())], names=["u", "v", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 4), np.uint64)]
        crowded = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 4)
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), bits]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = held[0][-1]
            cut = np.searchsorted(held[0], last)
            yield from finish(*(x[:cut] for x in held), crowded)
            held = [x[cut:] for x in held]
            if len(held[0]) > bucket or crowded == last:
                crowded = last
                yield emit(held[1], None, held[0])
                held = [x[:0] for x in held]
        yield from finish(*held, crowded)

    def finish(key, h, bits, crowded):
        if not len(key):
            return
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        size = np.diff(np.append(first, len(key)))
        many = np.repeat((size > bucket) | (key[first] == crowded if crowded is not None else False), size)
        if many.any():
            yield emit(h[many], None, key[many])
        few = (size <= bucket) & ~many[first]
        first, size = first[few], size[few]
        left, right = [], []
        pair = first[size == 2]
        near = pair[np.bitwise_count(bits[pair] ^ bits[pair + 1]).sum(1) <= most]
        left.append(h[near])
        right.append(h[near + 1])
        for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = solve(h[i : i + n], bits[i : i + n])
            left.append(a)
            right.append(b)
        a, b = _forest(np.concatenate(left), np.concatenate(right))
        if len(a):
            yield emit(a, b)

    return run


def _same(sets: list[np.ndarray], bits: np.ndarray, most: int) -> np.ndarray:
    """Labels of the groups that all pairs with a Jaccard similarity of at least SIMILAR join."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    label = np.arange(n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
    for i in range(n - 1):
        other = np.arange(i + 1, n)
        other = other[label[other] != label[i]]
        # Sets of too different sizes can't be alike.
        low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[SIMILAR[1] * low >= SIMILAR[0] * high]
        other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(1) <= most]
        if not len(other):
            continue
        mark[code[start[i] : start[i + 1]]] = True
        both = np.array([np.count_nonzero(mark[code[start[j] : start[j + 1]]]) for j in other.tolist()])
        mark[code[start[i] : start[i + 1]]] = False
        near = other[SIMILAR[1] * both >= SIMILAR[0] * (size[other] + size[i] - both)]
        if len(near):
            label[np.isin(label, label[near])] = label[i]
    return label


def _verified(most: int):
    """Sorted (group, h, bits, shingles) in; links (u, v) between a verified group's members and one of them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, bits, sets = None, [], [], []
        for batch in batches:
            for component, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != now:
                    yield from finish(h, bits, sets)
                    now, h, bits, sets = component, [], [], []
                h.append(row[0])
                bits.append(row[1])
                sets.append(np.frombuffer(row[2], np.uint64))
        yield from finish(h, bits, sets)

    def finish(h, bits, sets):
        if len(h) < 2:
            return
        label = _same(sets, np.frombuffer(b"".join(bits), np.uint64).reshape(-1, 4), most)
        at = np.array(h, np.int64)
        moved = label != np.arange(len(h))
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(at[moved]), pa.array(at[label[moved]])], names=["u", "v"])

    return run


def _across(most: int):
    """Sorted (group, side, h, label, bits, shingles) in; links (u, v) between rows of side 1 and those of side 0 that have another label. Side 1 is streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, label, bits, sets = None, [], [], [], []
        size = own_bits = own_label = np.empty(0)
        for batch in batches:
            u, v = [], []
            for group, side, a, name, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group != now:
                    now, h, label, bits, sets, size = group, [], [], [], [], np.empty(0)
                one = np.frombuffer(c, np.uint64)
                if side == 0:
                    h.append(a)
                    label.append(name)
                    bits.append(b)
                    sets.append(one)
                    continue
                if len(size) != len(h):
                    size, own_label = np.array([len(x) for x in sets]), np.array(label, np.int64)
                    own_bits = np.frombuffer(b"".join(bits), np.uint64).reshape(-1, 4)
                if not len(h):
                    continue
                n = len(one)
                other = np.nonzero((own_label != name) & (SIMILAR[1] * np.minimum(size, n) >= SIMILAR[0] * np.maximum(size, n)))[0]
                other = other[np.bitwise_count(own_bits[other] ^ np.frombuffer(b, np.uint64)).sum(1) <= most]
                for j in other.tolist():
                    both = len(np.intersect1d(sets[j], one, assume_unique=True))
                    if SIMILAR[1] * both >= SIMILAR[0] * (len(sets[j]) + n - both):
                        u.append(a)
                        v.append(h[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


#: Bytes of shingle sets that are compared with each other in one task.
TASK_BYTES = 64 << 20


def _verified_links(sets: DataFrame, most: int, limit: int) -> tuple[DataFrame, bool]:
    """sets(component, h, bits, shingles), written -> (u, v): links that join what all pairs of a component at SIMILAR join; and whether they are stars around v.

    A component of more than ``limit`` bytes is dealt out in blocks: each block is solved, then what its groups' first members
    make of each other. Only rows outside the component's largest group so far are then compared with all others of
    another group, block by block; in a large group of near copies these are few.
    """
    sizes = sets.groupBy("component").agg(F.ceil(F.sum(F.length("shingles") + 64) / limit).cast("int").alias("blocks"))
    big = write_table(sizes.filter("blocks > 1"), "big-components")
    if big.isEmpty():
        ordered = sets.select("component", "h", "bits", "shingles").repartition("component").sortWithinPartitions("component", "h")
        return write_table(ordered.mapInArrow(_verified(most), "u bigint, v bigint"), "verified"), True
    rows = sets.join(big, "component", "left").withColumn("block", F.pmod(F.xxhash64("h"), F.coalesce("blocks", F.lit(1))).cast("int"))
    group = F.when(F.col("blocks").isNull(), F.col("component")).otherwise(F.xxhash64("component", "block"))
    ordered = rows.select(group.alias("group"), "h", "bits", "shingles").repartition("group").sortWithinPartitions("group", "h")
    links = write_table(ordered.mapInArrow(_verified(most), "u bigint, v bigint"), "verified")
    wide = rows.filter("blocks is not null").join(links.select(F.col("u").alias("h"), F.col("v").alias("label")), "h", "left").withColumn("label", F.coalesce("label", "h"))
    wide = write_table(wide, "wide")
    first = write_table(wide.filter("h = label").select("component", "h", "bits", "shingles"), "first-members")
    if first.count() < wide.count():
        links = links.union(_verified_links(first, most, limit)[0])
    joined = connected_components(links).withColumnsRenamed({"node": "h", "component": "whole"})
    wide = write_table(wide.drop("label").join(joined, "h", "left").withColumn("label", F.coalesce("whole", "h")).drop("whole"), "wide")
    by_label = wide.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum(F.length("shingles") + 64).alias("bytes"))
    main = by_label.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("bytes") - F.max_by("bytes", F.struct("n", "label"))).alias("rest"))
    main = write_table(main.filter("rest > 0").withColumn("parts", F.ceil(F.col("rest") / limit).cast("int")), "main-groups")
    held = wide.join(main, "component")
    part = F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    still = held.withColumn("part", every("parts")).withColumn("side", F.lit(0))
    moved = held.filter("label != main").withColumn("part", part).drop("block").withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    both = still.unionByName(moved, allowMissingColumns=True).select(F.xxhash64("component", "block", "part").alias("group"), "side", "h", "label", "bits", "shingles")
    across = both.repartition("group").sortWithinPartitions("group", "side", "h").mapInArrow(_across(most), "u bigint, v bigint")
    return write_table(links.union(across.distinct()), "verified"), False


def similar_groups(docs: DataFrame, most: int = SIMILAR_BITS, bucket: int = BUCKET, limit: int = TASK_BYTES) -> DataFrame:
    """h (hash of a text), doc_id (its least), component (the group, by a member's hash), component_id (its least doc_id).

    A row for each different text. Groups may share a component_id, null among them. Texts that share 0.8 of their five-word
    shingles differ in few words, so their word and word-pair
    fingerprints fall within the reach of the deletion variants although those of the shingles, some ten bits
    apart, don't. Candidates come from the variants of both, if 256 bits of the shingle sets aren't too far
    apart. Members of a key that is crowded even when cut once more are all candidates of each other. What candidates join is
    then compared by the sets themselves, and only pairs that share 0.8 are links. Each text of such a candidate
    group is read once more; a task holds ``limit`` bytes of sets.
    """
    small_batches(docs.sparkSession)
    fields = [("a", "bigint", pa.int64()), ("b", "bigint", pa.int64()), ("bits", "binary", pa.binary())]
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    drawn = per_row(hashed, ["doc_id", "h"], fields, lambda: sketch)
    texts = write_table(drawn.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("a", "b", "bits")).alias("s")).select("h", "doc_id", "s.*"), "sketches")
    keys = F.concat(_variants(F.col("a")), F.transform(_variants(F.col("b")), lambda k: k + F.lit(BITS << SLOT)))

    def candidates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        ordered = keyed.repartition("key").sortWithinPartitions("key", "h")
        found = write_table(ordered.mapInArrow(_similar(most, bucket), "u bigint, v bigint, key bigint").distinct(), "similar")
        return found.filter("key is null").select("u", "v"), found.filter("key is not null").select("key", F.col("u").alias("h"))

    found, crowd = candidates(texts.select(F.explode(keys).alias("key"), "h", "bits"))
    if not crowd.isEmpty():
        fp = F.when(F.shiftrightunsigned("key", SLOT) < BITS, F.col("a")).otherwise(F.col("b"))
        more, crowd = candidates(crowd.join(texts, "h").select(F.explode(_rest_variants(F.col("key"), fp)).alias("key"), "h", "bits"))
        least = crowd.groupBy("key").agg(F.min("h").alias("v"))
        found = found.union(more).union(crowd.join(least, "key").filter("h != v").select("h", "v"))
    loose = connected_components(found).withColumnRenamed("node", "h")
    members = write_table(texts.select("h", "bits").join(loose, "h"), "candidates")
    # Copies of a text fall together before the exchange.
    once = hashed.groupBy("h").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")).join(members, "h")
    sets = write_table(per_row(once, ["component", "h", "bits"], [("shingles", "binary", pa.binary())], lambda: lambda text: (shingle_set(text),)), "shingle-sets")
    links_, stars = _verified_links(sets, most, limit)
    sure = links_.select(F.col("u").alias("h"), F.col("v").alias("component")) if stars else connected_components(links_).withColumnRenamed("node", "h")
    of = texts.select("h", "doc_id").join(sure, "h", "left").withColumn("component", F.coalesce("component", "h"))
    named = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return of.join(named, "component").select("h", "doc_id", "component", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with docs' columns: the one with the least doc_id.

    Texts are near-duplicates if they share 0.8 or more of their different five-word shingles.
    Where several of its texts have that doc_id, the one that hashes lowest stays; of equal rows one stays.
    A null doc_id is the least only where a group has no other. Null and wordless texts are one group.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h")).alias("s")
    doc, h = fresh(docs, "doc"), fresh(docs, "hash")
    chosen = write_table(similar_groups(docs).groupBy("component").agg(least).select(F.col("s.doc_id").alias(doc), F.col("s.h").alias(h)), "kept")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[doc]) & (own == chosen[h]), "left_semi")
    twice = docs.groupBy("doc_id", own.alias(h)).count().filter("count > 1").limit(1)
    return kept if twice.isEmpty() else kept.withColumn(h, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", h]).drop(h)
