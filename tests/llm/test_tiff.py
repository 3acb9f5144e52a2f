import random
import struct

import numpy as np
import pytest

from millrace.llm import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_round_trip(order, how, predictor, tiled):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (70, 45, 3), np.uint8), np.repeat(rng.integers(0, 9, (33, 10, 1), np.uint8), 9, axis=1)]
    got = list(tiff.pages(tiff.write([(i, how, predictor, tiled) for i in images], order)))
    assert [p.data for p in got] == [i.tobytes() for i in images]
    assert [(p.width, p.height, p.samples, p.tiled) for p in got] == [(45, 70, 3, tiled), (90, 33, 1, tiled)]


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 300, 5000, 70000])
def test_codecs(n):
    rnd = random.Random(n)
    for data in (bytes(rnd.choices(b"ab ", k=n)), rnd.randbytes(n), b"z" * n):
        assert tiff.unlzw(tiff.lzw(data)) == data
        assert tiff.unpackbits(tiff.packbits(data), n) == data


def test_lzw_as_the_format_has_it():
    # The format's own example: 7 7 7 8 8 7 7 6 6 gives the codes 256 7 258 8 8 258 6 6 257.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw and tiff.unlzw(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_broken_files(spark):
    good = tiff.store(tiff.payload(b"text " * 20000))
    loop = bytearray(tiff.store(tiff.payload(b"x")))
    (at,) = struct.unpack_from("<I", loop, 4)
    (n,) = struct.unpack_from("<H", loop, at)
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b"no"), (4, None), (5, bytes(loop)), (1, good)]
    got = tiff.read_pages(spark.createDataFrame([(i, bytearray(b) if b else None) for i, b in rows], "doc_id bigint, media binary")).collect()
    whole = [r for r in got if r.doc_id == 1]
    assert len(whole) == 2 * 3 and b"".join(bytes(r.data) for r in sorted(whole[:3], key=lambda r: r.page)).rstrip() == (b"text " * 20000).rstrip()
    assert all(any(r.error for r in got if r.doc_id == i) for i in (2, 3, 4, 5))


def test_digests(spark):
    texts = [None, "", "a", "é" * 96, "b" * 192, "c" * 193, "long text " * 60000, "a"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, media string")
    got = {r.doc_id: r for r in tiff.digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[i].n_bytes == len(raw) and got[i].payload_bytes == max(192, -(-len(raw) // 192) * 192)
        assert tuple(got[i])[1:] == tiff.digest(raw)
    assert tuple(got[2])[1:] == tuple(got[7])[1:] and tuple(got[0])[1:] == tuple(got[1])[1:]
    back = {}
    for r in sorted(tiff.read_pages(tiff.to_media(df)).collect(), key=lambda r: (r.doc_id, r.page)):
        back[r.doc_id] = back.get(r.doc_id, b"") + bytes(r.data)
    assert all(back[i] == tiff.payload((t or "").encode()) for i, t in enumerate(texts))
    assert tiff.digests(df.limit(0)).count() == 0


def plain_reader(blob):
    """The samples of all pages, decoded step by step after the format's description; shares no code with the module."""
    import struct
    import zlib

    def lzw(data):
        bits = "".join(f"{b:08b}" for b in data)
        at, out, table, width, before = 0, b"", {}, 9, None
        while at + width <= len(bits):
            code = int(bits[at : at + width], 2)
            at += width
            if code == 256:
                table, width, before = {i: bytes([i]) for i in range(256)}, 9, None
                table[256] = table[257] = None
                continue
            if code == 257:
                break
            if not table:
                table = {i: bytes([i]) for i in range(256)} | {256: None, 257: None}
            word = table[code] if code in table else before + before[:1]
            out += word
            if before is not None:
                table[len(table)] = before + word[:1]
                width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
            before = word
        return out

    def packbits(data):
        out, i = b"", 0
        while i < len(data):
            n = data[i] - 256 if data[i] > 127 else data[i]
            if n >= 0:
                out, i = out + data[i + 1 : i + 2 + n], i + 2 + n
            else:
                out, i = out + data[i + 1 : i + 2] * (1 - n if n > -128 else 0), i + 2
        return out

    assert blob[:4] == b"II*\0"
    at, out, seen = struct.unpack("<I", blob[4:8])[0], b"", set()
    while at:
        (n,) = struct.unpack("<H", blob[at : at + 2])
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack("<HHI", blob[at + 2 + 12 * i : at + 10 + 12 * i])
            size = {3: 2, 4: 4}[kind] * count
            raw = blob[at + 10 + 12 * i : at + 14 + 12 * i]
            raw = raw[:size] if size <= 4 else blob[(p := struct.unpack("<I", raw)[0]) : p + size]
            tags[tag] = struct.unpack("<" + {3: "H", 4: "I"}[kind] * count, raw)
        width, height, how = tags[256][0], tags[257][0], tags[259][0]
        seen.add(how)
        tiled = 324 in tags
        rows, across = (tags[323][0], tags[322][0]) if tiled else (tags[278][0], width)
        image = [[None] * width for _ in range(height)]
        k = 0
        for y in range(0, height, rows):
            for x in range(0, width, across):
                o, size = tags[324 if tiled else 273][k], tags[325 if tiled else 279][k]
                k += 1
                data = {8: zlib.decompress, 5: lzw, 32773: packbits}[how](blob[o : o + size])
                for r in range(rows):
                    line = [list(data[(r * across + c) * 3 : (r * across + c) * 3 + 3]) for c in range(across)]
                    if tags[317][0] == 2:
                        for c in range(1, len(line)):
                            line[c] = [(a + b) % 256 for a, b in zip(line[c], line[c - 1], strict=False)]
                    for c in range(across):
                        if y + r < height and x + c < width:
                            image[y + r][x + c] = bytes(line[c])
        out += b"".join(b"".join(line) for line in image)
        (at,) = struct.unpack("<I", blob[at + 2 + 12 * n : at + 6 + 12 * n])
    return out, seen


def test_files_by_an_independent_reader():
    import random

    rnd = random.Random(3)
    kinds = set()
    texts = [b"", b"a", "ä b".encode() * 70, bytes(rnd.choices(b"abc \n", k=30_000)), b"x" * 200_000, bytes(rnd.randrange(256) for _ in range(70_000))]
    texts += [bytes(rnd.choices(b"the quick brown fox ", k=rnd.randint(1, 3000))) for _ in range(25)]
    for text in texts:
        data, seen = plain_reader(tiff.store(tiff.payload(text)))
        assert data == text + b" " * (len(data) - len(text)) and len(data) % 192 == 0 and len(data) > 0 and len(data) - len(text) <= 192
        kinds |= seen
    assert kinds == {tiff.LZW, tiff.DEFLATE, tiff.PACKBITS}
