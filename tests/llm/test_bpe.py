import base64
import hashlib
import random

import numpy as np
import pytest

from concordat.llm import bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(PATH)


def texts():
    rnd = random.Random(4)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "٣", "!", "?", "日", "\x1c", "\x85", "😀", "n't", "'S", "\r\n", "​", "́", "\0"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    ranges = [(32, 127), (0xA0, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    out += ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(25)) for _ in range(500)]
    return out + ["a" * 5000, "ab" * 3000, "!" * 2000, " " * 700 + "x", " " * 700, "", "'" * 50 + "s", "<|endoftext|>", "x\n\n\n y"]


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_encoding_matches_the_library(reference, vocab):
    rows = texts()
    for text, got in zip(rows, vocab.encode(rows)):
        assert ids(got) == reference.encode_ordinary(text), repr(text)
        assert vocab.decode(got) == text.encode()
        offsets = vocab.offsets(got)
        assert offsets[-1] == len(text.encode()) and all(vocab.decode(got[4 * i : 4 * i + 4]) == text.encode()[offsets[i] : offsets[i + 1]] for i in range(min(5, len(ids(got)))))


def test_classes_of_all_code_points_are_the_librarys():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = bpe.class_table()
    for pattern, kinds in ((r"\p{L}", [bpe.LETTER]), (r"\p{N}", [bpe.NUMBER]), (r"\s", [bpe.SPACE, bpe.BLANK])):
        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        want = [ord(c) for c in one.decode(one.encode_ordinary(every))]
        assert np.flatnonzero(np.isin(table, kinds)).tolist() == want


def test_all_assigned_code_points_in_contexts(reference, vocab):
    import unicodedata

    added = [c for a, b in (*bpe.LETTERS_16, *bpe.NUMBERS_16) for c in range(a, b + 1)]
    points = sorted({c for c in range(0x110000) if unicodedata.category(chr(c))[0] != "C"} | set(added))
    for at in range(0, len(points), 20_000):
        rows = [f(chr(c)) for c in points[at : at + 20_000] for f in ("{0}'s".format, "!{0}!".format, "1{0}1".format)]
        for text, got in zip(rows, vocab.encode(rows)):
            if ids(got) != reference.encode_ordinary(text):
                raise AssertionError(repr(text))


def test_another_unicode_is_an_error(monkeypatch):
    monkeypatch.setattr(bpe, "LETTERS_16", bpe.LETTERS_16[1:])
    with pytest.raises(RuntimeError, match="Unicode"):
        bpe.class_table.__wrapped__()


def test_long_slices_merge_like_short_ones(vocab):
    rnd = random.Random(9)
    for _ in range(200):
        piece = bytes(rnd.choice(b"abcde etaoin") for _ in range(rnd.randrange(2, 90)))
        if piece not in vocab.ranks:
            assert vocab.merge(piece) == vocab._merge_long(piece)


def test_scan_equals_stepping_through_the_automaton():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        symbols = rnd.integers(0, 9, n).astype(np.uint8)
        states, at = [], bpe.FRESH
        for y in symbols:
            states.append(at)
            at = bpe._step(at, int(y))[0]
        assert bpe.scan_states(symbols).tolist() == states


def test_cache_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 5)
    vocab.cache.clear()
    vocab.encode([" ".join(f"w{i}" for i in range(50))])
    assert len(vocab.cache) <= 5


def test_queries_over_odd_rows(spark, reference):
    rows = [(1, None, "c", "c"), (1, "", "c", "c"), (None, "two words", "c", "c"), (2, "it's" * 20_000, "c", "c"), (3, "same", "c", "c"), (3, "same", "c", "c")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, bpe.round_trip_digests(df, PATH).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        e = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(e) // 4, hashlib.sha256(e).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    coded = bpe.encode(df, PATH)
    back = {bytes(r["bytes"]) for r in bpe.decode(coded, PATH).collect()}
    assert back == {(t or "").encode() for _, t, *_ in rows}
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_ids_outside_of_the_vocabulary(vocab):
    with pytest.raises(ValueError):
        vocab.decode(np.array([999_999], "<u4").tobytes())
