import base64
import hashlib
import random
import time

import pytest
import tiktoken

tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe  # noqa: E402

PATH = tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, ids string, w int"


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    bits = ["hello", "world's", "É", "ß", "日本", "1234", "!!", " ", "  ", "\n", "\n\n", "\t", "\xa0", "　", "\x1c", "<|endoftext|>", "don't", "x" * 50, "🙂"]
    made = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 40))) for _ in range(120)]
    return [*made, "", " ", "\n", " a", "a ", "a  b", "word " * 5000, "abcdefghij" * 300, "́" * 900, "plain words in a row, and more."]


def test_as_the_library_does_and_back(spark, own):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(-1, None, None, None), (0, texts()[0], "clash", 1)]
    coded = bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, tokenizers.PATTERN).cache()
    by = {r.doc_id: r for r in coded.collect()}
    assert coded.count() == len(rows) and by[-1].n_tokens == 0 and by[-1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t, *_ in rows:
        want = own.encode_ordinary(t or "")
        assert by[i].ids == want and by[i].n_tokens == len(want), repr(t)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(coded.select("doc_id", "ids"), PATH, tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)


def slow(codec, piece):
    """The ids of a piece: the leftmost pair of least rank, again and again."""
    t = [bytes([b]) for b in piece]
    while pairs := [(codec.ranks[a + b], i) for i, (a, b) in enumerate(zip(t, t[1:], strict=False)) if a + b in codec.ranks]:
        _, i = min(pairs)
        t[i : i + 2] = [t[i] + t[i + 1]]
    return [codec.ranks[x] for x in t]


def test_frames_and_whole_pieces_agree():
    codec = bpe.Codec(PATH)
    rnd = random.Random(1)
    pieces = list({bytes(rnd.choices(letters, k=rnd.randint(1, 180))) for letters in (b" abcdefghinorstu", b"etaoinshrdlu", b"at", b"a") for _ in range(60)})
    for p, (ids, n, back) in zip(pieces, codec.encode(pieces), strict=True):
        assert [int(i) for i in ids.split()] == slow(codec, p) and n == len(ids.split()) and back == p


def test_long_pieces_go_in_blocks(own):
    texts = bpe.Texts(PATH, tokenizers.PATTERN)
    texts.codec.block = 3000
    rnd = random.Random(2)
    words = [w for w in "the quick brown foxes jumped over lazy dogs while reading interesting documentation about transformers and international organisations".split()]
    for t in ("ha" * 10_000, "a" * 15_001, "".join(rnd.choices(words, k=1500)), "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))):
        (parts,) = texts.encode([t])
        assert b" ".join(p[0] for p in parts) == " ".join(map(str, own.encode_ordinary(t))).encode()


def test_long_texts_of_many_different_words(spark, own):
    rnd = random.Random(4)
    made = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäé", k=rnd.randint(4, 14))) for _ in range(400_000)), "\t" + "x; " * 300_000, " " * 20_000 + "end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(rows, PATH, tokenizers.PATTERN, with_ids=False).collect()}
    for i, t in enumerate(made):
        want = own.encode_ordinary(t)
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH, tokenizers.PATTERN).count() == 0


def test_an_idle_worker_lets_go_of_caches(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE", 0.3)
    monkeypatch.setattr(bpe, "_open", {})
    task = bpe._held(lambda batches: (bpe._texts(PATH, tokenizers.PATTERN).encode([b]) for b in batches))
    first = list(task(["one two"]))
    held = bpe._open[PATH, tokenizers.PATTERN]
    assert list(task(["one two"])) == first and bpe._open[PATH, tokenizers.PATTERN] is held
    time.sleep(1)
    assert not bpe._open and list(task(["one two"])) == first
