"""Byte-level BPE by recursive DuckDB queries in each partition.

A text is cut by the tokenizer's pattern; each distinct piece is encoded once a worker. Its bytes are rows
(piece, position, id). A recursive query joins neighbouring rows with the merge table, contracts the
leftmost pair of least rank of each piece, and ends where no pair merges. An ordered aggregation
writes the ids out and joins them with the token table for the decoded bytes.

A piece of more than ``FRAMED`` bytes has the same recursion with a frame instead of the whole piece: a pair is
contracted once no pair within ``reach`` tokens has a lower rank, for what is further off can only get to
it as one token longer than any in the table. So each round contracts a pair in every frame. Such a
piece goes through in blocks; what isn't settled at a block's end is carried into the next.

Nothing is exchanged. Everything is bounded by bytes: a query gets at most ``QUERY`` bytes of new pieces, a long
text is cut into slices where no token can cross, and caches that are full keep what the group at hand
uses, which costs time only.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import hashlib
import threading
from collections import ChainMap
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.texts import small_batches, utf8

#: Bytes of texts that are encoded together, of new pieces in one query, of each cache, and of a string that is cached at all.
GROUP, QUERY, CACHED, CACHED_ONE = 2_000_000, 500_000, 110_000_000, 200
#: Bytes beyond which a piece's recursion works in frames, and bytes of a block of such a piece.
FRAMED, BLOCK = 64, 60_000
#: Bytes that an entry of a cache takes besides its text.
ENTRY = 150
#: White space besides space and line feed, as the pattern's \s has it.
_OTHER_SPACE = regex.compile("[\\t\\r\\x0b\\x0c\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")

#: g is a byte's piece and position in it.
CONTRACT = """
with recursive step(g, id, done) as (
    select (w::bigint << 20) | pos, id, false from piece_bytes
    union all
    select g, case when g = place then merged else id end, place is null from (
        with paired as (
            select g, id, lead(id) over near as next_id, lead(g >> 20) over near as next_w, lag(g) over near as before
            from step where not done window near as (order by g)
        ), ranked as (
            select p.g, p.id, p.before, m.merged from paired p left join merges m on p.next_w = p.g >> 20 and m.l = p.id and m.r = p.next_id
        ), best as (
            select g >> 20 as w, min((merged::bigint << 20) | (g & 1048575)) as k from ranked group by 1
        )
        select r.g, r.id, r.before, case when k is not null then (w << 20) | (k & 1048575) end as place, (k >> 20)::int as merged from ranked r join best on w = r.g >> 20
    ) where place is null or before is distinct from place
)
select g >> 20 as w, string_agg(id::varchar, ' ' order by g) as ids, count(*)::int as n, unhex(string_agg(hex(token), '' order by g)) as bytes
from step join tokens using (id) where done group by 1 order by 1
"""


#: In each frame the leftmost pair of least rank; of equal pairs in a row every other one, if the first can be judged. Rows
#: within ``reach`` of an open end can't be judged yet.
FRAMES = """
with recursive step(w, pos, id, round, live) as (
    select 0, pos, id, 0, true from piece_bytes
    union all
    select w, pos, new_id, round + 1, any_hit from (
        with paired as (
            select w, pos, id, round, lead(id) over (order by pos) as next_id, row_number() over (order by pos) as n, count(*) over () as total from step where live
        ), ranked as (
            select p.*, case when $open and p.n > p.total - {reach} then null else m.merged end as k, case when $open and p.n > p.total - {reach} then -1 else m.merged end as seen
            from paired p left join merges m on m.l = p.id and m.r = p.next_id
        ), framed as (
            select *, min(seen) over (order by pos rows between {reach} preceding and 1 preceding) as lo, min(seen) over (order by pos rows between 1 following and {reach} following) as hi from ranked
        ), least as (
            select *, k is not null and (lo is null or k <= lo) and (hi is null or k <= hi) as hit from framed
        ), runs as (
            select *, sum(case when k is not distinct from before then 0 else 1 end) over (order by pos rows unbounded preceding) as run from (select *, lag(k) over (order by pos) as before from least)
        ), chosen as (
            select *, hit and row_number() over same % 2 = 1 and bool_and(hit) over same as take from runs window same as (partition by run order by pos rows unbounded preceding)
        ), marked as (
            select *, lag(take) over (order by pos) as gone, max(take) over () as any_hit from chosen
        )
        select w, pos, case when take then k else id end as new_id, round, any_hit from marked where gone is distinct from true
    )
)
select pos, id from step where not live order by pos
"""


class Codec:
    """Encodes pieces by a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str, block: int = BLOCK) -> None:
        self.block = block
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        self.tokens = {v: k for k, v in ranks.items()}
        pairs = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Pairs of bytes that stand in some token; between others every piece falls apart.
        self.inside = np.zeros(1 << 16, bool)
        for t in ranks:
            both = np.frombuffer(t, np.uint8).astype(np.int32)
            self.inside[both[:-1] << 8 | both[1:]] = True
        self.by_size = sorted((t for t in ranks if len(t) > 8), key=len, reverse=True)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", l=[p[0] for p in pairs], r=[p[1] for p in pairs], merged=[p[2] for p in pairs])
        self._table("tokens", id=list(ranks.values()))
        self.db.register("seen", pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks, pa.binary())}))
        self.db.execute("create or replace table tokens as select * from seen")
        self.db.unregister("seen")

    def _table(self, name: str, **cols) -> None:
        self.db.register("seen", pa.table({k: pa.array(v, pa.int32()) for k, v in cols.items()}))
        self.db.execute(f"create table {name} as select * from seen")
        self.db.unregister("seen")

    def encode(self, pieces: list[bytes]) -> list[tuple[bytes, int, bytes]]:
        """Of each piece: its ids joined by spaces, their number, and the bytes they decode to."""
        by: dict[bytes, tuple[bytes, int, bytes]] = {}
        group: list[bytes] = []
        size = 0
        for p in pieces:
            if len(p) > FRAMED:
                by[p] = self._long(p)
            elif p:
                group.append(p)
                size += len(p)
                if size >= QUERY:
                    by.update(self._short(group))
                    group, size = [], 0
        by.update(self._short(group))
        return [by[p] for p in pieces]

    def _short(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, int, bytes]]:
        if not pieces:
            return {}
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        rows = pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), size), "pos": pos.astype(np.int32), "id": self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]})
        self.db.register("piece_bytes", rows)
        found = self.db.execute(CONTRACT).fetchall()
        self.db.unregister("piece_bytes")
        return {p: (ids.encode(), n, bytes(out)) for p, (_, ids, n, out) in zip(pieces, found, strict=True)}

    def _long(self, piece: bytes) -> tuple[bytes, int, bytes]:
        """A long piece falls apart between bytes that no token joins; long parts are contracted in frames."""
        own = np.frombuffer(piece, np.uint8).astype(np.int32)
        cuts = [0, *(np.nonzero(~self.inside[own[:-1] << 8 | own[1:]])[0] + 1).tolist(), len(piece)]
        parts = [piece[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        by: dict[bytes, tuple[bytes, int, bytes]] = {}
        short = list({p for p in parts if len(p) <= FRAMED})
        at = size = 0
        for i, p in enumerate(short):
            size += len(p)
            if size >= QUERY or i == len(short) - 1:
                by.update(self._short(short[at : i + 1]))
                at, size = i + 1, 0
        for p in parts:
            if p not in by:
                by[p] = self._framed(p)
        found = [by[p] for p in parts]
        return b" ".join(x[0] for x in found), sum(x[1] for x in found), b"".join(x[2] for x in found)

    def _framed(self, piece: bytes) -> tuple[bytes, int, bytes]:
        reach = next((len(t) for t in self.by_size if len(t) <= len(piece) and t in piece), 8)
        ids: list[np.ndarray] = []
        held = np.empty(0, np.int32)
        for at in range(0, len(piece), self.block):
            now = np.concatenate([held, self.of_byte[np.frombuffer(piece[at : at + self.block], np.uint8)]])
            ends = at + self.block >= len(piece)
            now = self._contract(now, reach, not ends)
            settled = len(now) if ends else self._settled(now, reach)
            ids.append(now[:settled])
            held = now[settled:]
        out = np.concatenate(ids).tolist()
        tokens = self.tokens
        return b" ".join(b"%d" % i for i in out), len(out), b"".join(tokens[i] for i in out)

    def _contract(self, ids: np.ndarray, reach: int, open_: bool) -> np.ndarray:
        self.db.register("piece_bytes", pa.table({"pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        found = self.db.execute(FRAMES.format(reach=reach), {"open": open_}).fetchnumpy()
        self.db.unregister("piece_bytes")
        return np.asarray(found["id"], np.int32)

    def _settled(self, ids: np.ndarray, reach: int) -> int:
        """Tokens before the last place where, over a reach of tokens, no neighbours merge: nothing crosses it any more."""
        tokens, ranks = self.tokens, self.ranks
        still, i = 0, len(ids) - 1 - reach
        while i > 0:
            if tokens[ids[i - 1]] + tokens[ids[i]] in ranks:
                still = 0
            else:
                still += 1
                if still > reach:
                    return i + reach // 2
            i -= 1
        return 0

    def decode(self, rows: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation."""
        self.db.register("coded", pa.table({"w": pa.array(range(len(rows)), pa.int32()), "ids": pa.array(rows, pa.list_(pa.int32()))}))
        got = self.db.execute(
            "select w, unhex(string_agg(hex(token), '' order by pos)) from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as pos from coded) join tokens using (id) group by w"
        ).fetchall()
        self.db.unregister("coded")
        by = {w: bytes(b) for w, b in got}
        return [by.get(i, b"") for i in range(len(rows))]


class Texts:
    """Encodes texts: the pattern, the codec, and caches of pieces and of stretches between spaces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.codec, self.find, self.finditer = Codec(path), regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.piece: dict[str, tuple[bytes, int, bytes]] = {}
        self.stretch: dict[str, tuple[bytes, int, bytes]] = {}
        self.piece_bytes = self.stretch_bytes = 0

    def _learn(self, pieces: set[str]) -> dict[str, tuple[bytes, int, bytes]]:
        """The pieces encoded; those that aren't cached come as an extra table."""
        new = [p for p in pieces if p not in self.piece]
        found = dict(zip(new, self.codec.encode([p.encode() for p in new]), strict=True))
        self.piece.update((p, x) for p, x in found.items() if len(p) <= CACHED_ONE)
        self.piece_bytes += sum(len(p) for p in new if len(p) <= CACHED_ONE) + ENTRY * len(new)
        return {p: x for p, x in found.items() if len(p) > CACHED_ONE}

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, int, bytes]]]:
        """For each text, its parts in order, each encoded.

        No token of the pattern has a space but at its start, so a text is cut before each single
        space between other characters, and such stretches are looked up whole. Texts with other runs of
        white space go piece by piece.
        """
        cut: list[tuple[list[str], list[str]]] = []
        whole: set[str] = set()
        loose: set[str] = set()
        for t in texts:
            parts = t.split(" ")
            if "" in parts or "\n " in t or " \n" in t or _OTHER_SPACE.search(t):
                head, parts = self.find(t), []
            else:
                head, parts = self.find(parts[0]), parts[1:]
                whole.update(parts)
            loose.update(head)
            cut.append((head, parts))
        if self.stretch_bytes > CACHED:  # what the group needs again stays
            self.stretch = {s: x for s in whole if (x := self.stretch.get(s))}
            self.stretch_bytes = sum(len(s) + ENTRY for s in self.stretch)
        pieces = {s: self.find(f" {s}") for s in whole if s not in self.stretch}
        loose = loose.union(*pieces.values())
        if self.piece_bytes > CACHED:
            self.piece = {p: x for p in loose if (x := self.piece.get(p))}
            self.piece_bytes = sum(len(p) + ENTRY for p in self.piece)
        long_pieces, one = self._learn(loose), self.piece
        if long_pieces:
            one = ChainMap(long_pieces, one)
        long_stretches = {}
        for s, own in pieces.items():
            x = [one[p] for p in own]
            joined = x[0] if len(x) == 1 else (b" ".join(v[0] for v in x), sum(v[1] for v in x), b"".join(v[2] for v in x))
            if len(s) <= CACHED_ONE:
                self.stretch[s] = joined
                self.stretch_bytes += len(s) + ENTRY
            else:
                long_stretches[s] = joined
        many = ChainMap(long_stretches, self.stretch) if long_stretches else self.stretch
        return [[one[p] for p in head] + [many[p] for p in parts] for head, parts in cut]


#: Seconds after a task's end in which a worker process keeps codec and caches for the next task; then other stages have the memory.
IDLE = 3.0
_open: dict[tuple[str, str], Texts] = {}
_closing: threading.Timer | None = None


def _texts(path: str, pattern: str) -> Texts:
    """One for each worker process, which Spark uses again for later tasks."""
    if _closing is not None:
        _closing.cancel()
    found = _open.get((path, pattern)) or Texts(path, pattern)
    _open[path, pattern] = found
    return found


def _close() -> None:
    _open.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _close_later() -> None:
    global _closing
    if _closing is not None:
        _closing.cancel()
    _closing = threading.Timer(IDLE, _close)
    _closing.daemon = True
    _closing.start()


def _held(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that lets go of what the worker process holds some time after its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _close_later()

    return whole


def slices(text: str, find: Callable[[str], Iterator], size: int = GROUP) -> Iterator[str]:
    """The text cut where no token crosses: before single spaces between other characters, else between tokens.

    ``find`` yields matches of the pattern; it runs over a text without such spaces.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size // 2
        while (cut := text.find(" ", cut, at + size)) > 0 and (text[cut - 1].isspace() or cut + 1 == len(text) or text[cut + 1].isspace()):
            cut += 1
        if cut <= 0:
            break
        yield text[at:cut]
        at = cut
    if len(text) - at <= size:
        yield text[at:]
        return
    rest, last = text[at:], 0
    for m in find(rest):
        if m.end() - last > size // 2:
            yield rest[last : m.end()]
            last = m.end()
    if last < len(rest):
        yield rest[last:]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256: a row for each row of docs.

    A null or empty text has no tokens. Repeated rows give equal rows; an empty table gives none; further
    columns are ignored. Special tokens' names are ordinary text. Texts of any length are
    encoded whole, slice by slice. Ranks are taken to be in the order of training.
    """
    small_batches(docs.sparkSession)
    inp = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _texts(path, pattern)
        for b in batches:
            n, ids = [0] * b.num_rows, [[] for _ in range(b.num_rows)]
            coded, decoded = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]

            def settle(group: list[tuple[int, str]]) -> None:
                for (i, _), parts in zip(group, texts.encode([t for _, t in group]), strict=True):
                    line = b" ".join([p[0] for p in parts])
                    coded[i].update(b" " + line if n[i] and line else line)
                    n[i] += sum([p[1] for p in parts])
                    decoded[i].update(b"".join([p[2] for p in parts]))
                    if with_ids:
                        ids[i].append(np.array(line.split(), np.int32))

            group: list[tuple[int, str]] = []
            size = 0
            for i, t in enumerate(b.column(1)):
                for part in slices(t.as_buffer().to_pybytes().decode("utf-8", "replace"), texts.finditer):
                    group.append((i, part))
                    size += len(part)
                    if size >= GROUP:
                        settle(group)
                        group, size = [], 0
            settle(group)
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([np.concatenate(x) if x else np.empty(0, np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols | {"ids_sha256": pa.array([x.hexdigest() for x in coded], pa.string()), "decoded_sha256": pa.array([x.hexdigest() for x in decoded], pa.string())})

    return inp.mapInArrow(_held(run), schema)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """coded(doc_id, ids) -> doc_id, text. Null ids and no ids give an empty text."""
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _texts(path, pattern).codec
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                out = codec.decode([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array([x.decode("utf-8", "replace") for x in out], pa.string())})

    return coded.select("doc_id", "ids").mapInArrow(_held(run), f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")
