"""Media columns: TIFF files in a binary column, a row for each page.

The reader walks the chain of image directories (either byte order), decodes strips or tiles that
are plain, PackBits, LZW or deflate, undoes the horizontal predictor, and yields each page's
8-bit samples. The writer stores bytes as such files. A task holds one Arrow batch and one file at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.texts import per_row, small_batches

#: Values of the format: compressions, field types with their sizes, and tags.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325

#: How a payload is laid out: 64 pixels of 3 samples make a row of 192 bytes.
ACROSS, PER_PIXEL, UNIT = 64, 3, 192
PAGE_ROWS, STRIP_ROWS, TILE = 256, 64, 32
#: The ways in which pages are stored, as their bytes' CRC-32 deals them out: compression, predictor, tiled.
WAYS = ((DEFLATE, 2, False), (PACKBITS, 1, True), (LZW, 2, False))


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    for m in re.finditer(rb"(.)\1{2,127}", data, re.S):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: the table grows by one a code, so their places decide."""
    return np.minimum(12, 9 + np.searchsorted([512, 1024, 2048], np.arange(258, 258 + n), side="right"))


def lzw(data: bytes) -> bytes:
    # Codes are held 8 bits up, so that a code and the byte after it make a key.
    table: dict[int, int] = {}
    parts: list[list[int]] = []
    codes: list[int] = []
    following, held = 258 << 8, data[0] << 8 if data else -1
    for b in memoryview(data)[1:]:
        longer = table.get(held | b)
        if longer:
            held = longer
            continue
        codes.append(held)
        table[held | b] = following
        following += 256
        held = b << 8
        if following == 4094 << 8:
            parts.append([*codes, 256 << 8])
            table, codes, following = {}, [], 258 << 8
    parts.append([*codes, *([held] if data else []), 257 << 8])
    flat = np.array([256 << 8, *(c for p in parts for c in p)], np.int32) >> 8
    widths = np.concatenate([[9], *(_widths(len(p)) for p in parts)])
    bits = np.unpackbits(flat.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


#: Codes that are decoded at once; a table has no more.
CODES = 4096


def _run(codes: np.ndarray) -> bytes:
    """What codes without a clear or end code stand for, from an empty table.

    Code k that isn't a byte is the word of an earlier code, its ``base``, and the first byte of the word after that.
    So words are chains of bases, and all are walked at once from their last bytes to their first.
    """
    order = np.arange(len(codes))
    base = np.where(codes < 256, -1, codes - 258)
    if (base >= order).any():
        raise ValueError("LZW code out of range")
    first = np.where(base < 0, order, base)
    while (base[first] >= 0).any():
        first = first[first]
    tail = codes[first[np.where(base < 0, order, base + 1)]].astype(np.uint8)
    sizes = np.zeros(len(codes), np.int64)
    steps, words, at = [], order, order
    while len(words):
        steps.append((words, tail[at]))
        sizes[words] += 1
        at = base[at]
        words, at = words[at >= 0], at[at >= 0]
    ends = np.cumsum(sizes)
    out = np.empty(sizes.sum(), np.uint8)
    for back, (words, last) in enumerate(steps, 1):
        out[ends[words] - back] = last
    return out.tobytes()


def _runs(codes: np.ndarray) -> list[bytes]:
    """As ``_run``, in parts: codes after the first ``CODES`` only name words of those."""
    head = codes[:CODES]
    out = [_run(head)]
    return out + [_run(np.concatenate([head, codes[i : i + CODES]]))[len(out[0]) :] for i in range(CODES, len(codes), CODES)]


def unlzw(data: bytes) -> bytes:
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int32)
    triples = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    out: list[bytes] = []
    start, most = 0, CODES
    while (left := 8 * len(data) - start) >= 9:
        widths = _widths(min(most, left // 9))
        ends = np.cumsum(widths)
        ends = ends[ends <= left]
        widths, at = widths[: len(ends)], start + ends - widths[: len(ends)]
        codes = triples[at >> 3] >> (24 - (at & 7) - widths) & (1 << widths) - 1
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        if not len(stops):
            if most < left // 9:  # a table that is never cleared
                most = left // 9
                continue
            out += _runs(codes)
            break
        out += _runs(codes[: stops[0]])
        if codes[stops[0]] == 257:
            break
        start, most = start + int(ends[stops[0]]), CODES
    return b"".join(out)


def squeeze(data: bytes, how: int) -> bytes:
    return {PLAIN: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits}[how](data)


def unsqueeze(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        return data
    if how == PACKBITS:
        return unpackbits(data, size)
    if how == LZW:
        return unlzw(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {how} isn't supported")


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def write(images: list[tuple[np.ndarray, int, int, bool]], order: str = "<") -> bytes:
    """A file of pages (samples[height, width, n], compression, predictor, tiled)."""
    out = bytearray(b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0")
    link = 4
    for image, how, predictor, tiled in images:
        height, width, n = image.shape
        rows, across = (TILE, TILE) if tiled else (min(STRIP_ROWS, height), width)
        offsets, sizes = [], []
        for y in range(0, height, rows):
            for x in range(0, width, across):
                part = image[y : y + rows, x : x + across]
                if tiled and part.shape[:2] != (rows, across):
                    part = np.pad(part, ((0, rows - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                block = squeeze(part.tobytes(), how)
                offsets.append(len(out))
                sizes.append(len(block))
                out += block
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * n), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [2 if n == 3 else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [rows]), (TILES, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIPS, 4, offsets), (ROWS, 4, [rows]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind][0]}", *values)
            if len(raw) > 4:
                raw, place = struct.pack(f"{order}I", len(out)), raw
                out += place
            entries.append(struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pages(blob: bytes) -> Iterator[Page]:
    """The pages of a file in order. Raises ValueError for what it can't read, a chain that loops included."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(blob[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    try:
        (at,) = struct.unpack_from(f"{order}I", blob, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            (count,) = struct.unpack_from(f"{order}H", blob, at)
            tags: dict[int, tuple[int, ...]] = {}
            for i in range(count):
                tag, kind, n = struct.unpack_from(f"{order}HHI", blob, at + 2 + 12 * i)
                if kind in TYPES:
                    code, size = TYPES[kind]
                    place = at + 10 + 12 * i
                    if n * size > 4:
                        (place,) = struct.unpack_from(f"{order}I", blob, place)
                    tags[tag] = struct.unpack_from(f"{order}{n}{code}", blob, place)
            yield _page(blob, tags)
            (at,) = struct.unpack_from(f"{order}I", blob, at + 2 + 12 * count)
    except (struct.error, KeyError, IndexError, zlib.error) as e:
        raise ValueError(f"broken TIFF file: {e!r}") from e


def _page(blob: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    width, height, n = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    how, predictor, tiled = tags.get(COMPRESSION, (PLAIN,))[0], tags.get(PREDICTOR, (1,))[0], TILES in tags
    if set(tags.get(BITS, (1,))) != {8} or tags.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
        raise ValueError("only 8-bit samples, pixel by pixel, with no or the horizontal predictor are supported")
    rows, across = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS, (height,))[0], height), width)
    blocks = iter(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True))
    image = np.empty((height, width, n), np.uint8)
    for y in range(0, height, rows):
        for x in range(0, width, across):
            offset, size = next(blocks, (len(blob), 0))
            tall = rows if tiled else min(rows, height - y)
            raw = unsqueeze(blob[offset : offset + size], how, tall * across * n)
            if len(raw) < tall * across * n:
                raise ValueError("a strip or tile is too short")
            part = np.frombuffer(raw, np.uint8, tall * across * n).reshape(tall, across, n)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + across] = part[: height - y, : width - x]
    return Page(width, height, n, how, predictor, tiled, image.tobytes())


def payload(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of a row."""
    return text + b" " * (UNIT if not text else -len(text) % UNIT)


def store(data: bytes) -> bytes:
    """A payload as a file: pages of 256 rows, each stored in one of ``WAYS``, which its bytes decide."""
    pages_ = [data[i : i + PAGE_ROWS * UNIT] for i in range(0, len(data), PAGE_ROWS * UNIT)]
    return write([(np.frombuffer(p, np.uint8).reshape(-1, ACROSS, PER_PIXEL), *WAYS[zlib.crc32(p) % len(WAYS)]) for p in pages_])


def feature(parts: list[Page]) -> str:
    """Pages, size, mean, deviation and entropy of the samples, from what was read back."""
    count = np.zeros(256, np.int64)
    for p in parts:
        count += np.bincount(np.frombuffer(p.data, np.uint8), minlength=256)
    total = count.sum()
    share = count / total
    values = np.arange(256)
    mean = float(share @ values)
    deviation = float(share @ (values - mean) ** 2) ** 0.5
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    return f"pages={len(parts)};width={parts[0].width};height={sum(p.height for p in parts)};mean={mean:.3f};deviation={deviation:.3f};entropy={entropy:.3f}"


def digest(text: bytes) -> tuple:
    """Stores a text as a file, reads the file's pages back, and describes both."""
    blob = store(payload(text))
    parts = list(pages(blob))
    data = b"".join(p.data for p in parts)
    return len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(parts)


DIGEST = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and what ``digest`` says of each row's whole text; null and empty texts are one row of blanks.

    Repeated rows give equal rows, an empty table none; further columns are ignored. A text and its file are in memory at a time.
    """
    return per_row(docs, ["doc_id"], DIGEST, lambda: digest)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as a TIFF file in a binary column."""
    return per_row(docs, ["doc_id"], [("media", "binary", pa.binary())], lambda: lambda t: (store(payload(t)),))


def read_pages(files: DataFrame) -> DataFrame:
    """files(doc_id, media) -> a row for each page: doc_id, page, width, height, samples, compression, predictor, tiled, data, error.

    A file that can't be read gives the pages before the fault and a row with the error; a null file
    gives only such a row. Repeated rows give repeated pages, an empty table none.
    """
    small_batches(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, data binary, error string"
    types = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]
    names = ["page", "width", "height", "samples", "compression", "predictor", "tiled", "data", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in enumerate(b.column(1)):
                rows: list[tuple] = []
                try:
                    if not blob.is_valid:
                        raise ValueError("no file")
                    for n, p in enumerate(pages(blob.as_py())):
                        rows.append((n, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.data, None))
                except ValueError as e:
                    rows.append((len(rows), *[None] * 7, str(e)))
                if rows:
                    ids = b.column(0).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", *names])

    return files.select("doc_id", F.col("media").cast("binary")).mapInArrow(run, schema)
