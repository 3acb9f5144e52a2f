import random
import time

import pytest

from millrace.llm import tiff


def bits(data, clear=4094):
    """The codes' bits, step by step after the format's description; ``clear``: at which size a table is cleared, None for never."""
    table, out, held = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    size, width = 258, 9
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        out.append((table[held], width))
        if size < 4096:
            table[held + bytes([b])] = size
        size, held = size + 1, bytes([b])
        if size == clear:
            out.append((256, 12))
            table, size = {bytes([i]): i for i in range(256)}, 258
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    if held:
        out.append((table[held], width))
        width = 9 + (size + 1 >= 512) + (size + 1 >= 1024) + (size + 1 >= 2048)
    text = "".join(f"{c:0{w}b}" for c, w in [*out, (257, width)])
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def texts():
    rnd = random.Random(8)
    for n in (0, 1, 2, 253, 254, 255, 256, 766, 767, 1790, 1791, 3835, 3836, 3837, 12_288, 30_000):
        yield rnd.randbytes(n)
        yield bytes(rnd.choices(b"ab ", k=n))
        yield b"z" * n


def test_same_bytes_as_step_by_step():
    for data in texts():
        assert tiff.lzw(data) == bits(data) and tiff.unlzw(bits(data)) == data


def test_tables_that_are_never_cleared():
    for data in texts():
        assert tiff.unlzw(bits(data, None)) == data


def test_streams_cut_short_and_codes_out_of_range():
    raw = tiff.lzw(bytes(range(256)) * 3)
    assert (bytes(range(256)) * 3).startswith(tiff.unlzw(raw[:200])) and tiff.unlzw(raw[:1]) == tiff.unlzw(b"") == b""
    for codes in ([256, 258], [256, 65, 259], [300]):
        text = "".join(f"{c:09b}" for c in codes) + "0" * 16
        with pytest.raises(ValueError):
            tiff.unlzw(int(text[: len(text) // 8 * 8], 2).to_bytes(len(text) // 8, "big"))


def test_time_grows_with_the_bytes():
    def took(n):
        data, began = random.Random(n).randbytes(n), time.process_time()
        assert tiff.unlzw(tiff.lzw(data)) == data
        return time.process_time() - began

    took(1000)
    assert took(240_000) < 48 * took(15_000)
