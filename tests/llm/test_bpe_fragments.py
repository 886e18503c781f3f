import hashlib
import random
import struct
import unicodedata

import numpy as np
import pytest

from concordat.llm import bpe_fragments as B

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return B.Tokenizer(PATH)


def texts():
    rnd = random.Random(7)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "٣", "!", "日", "本語", "\x1c", "\x85", "😀", "n't", "'S", "\r\n", "​", "́", "\0", "<|endoftext|>", "<|", "endoftext", "|>"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    ranges = [(32, 127), (0xA0, 0x3000), (0x3000, 0xD7FF), (0xE000, 0x1FFFF)]
    out += ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(25)) for _ in range(500)]
    return out + ["a" * 5000, "ab" * 3000, "!" * 2000, " " * 700 + "x", " " * 700, "", "'" * 50 + "s", "<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "x\n\n\n y", "日" * 3000]


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_encoding_and_decoding_match_the_library(library, own):
    many = texts()
    want = [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
    got = own.encode(many)
    assert [ids(g) for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want] == many


def test_every_assigned_code_point(library, own):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    many = ["".join(f"a{c}1 {c}{c}" for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    assert [ids(g) for g in own.encode(many)] == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]


def test_cuts_are_forced_and_fragments_short(own):
    text = "".join(chr(0x4E00 + k % 5000) for k in range(5000))  # one word for the pre-tokeniser
    raw = text.encode()
    at = own.cuts(text + "\n", raw + b"\n", np.array([len(text)]))
    assert len(at) > 1000 and np.diff(at).max() < 200
    for token in list(own.merges.values())[:2000]:
        piece = own.bytes[own.starts[token[1]] : own.starts[token[1]] + own.lengths[token[1]]].tobytes()
        assert not own.never[np.frombuffer(piece, np.uint8)[:-1].astype(int) << 8 | np.frombuffer(piece, np.uint8)[1:]].any()


def test_short_and_long_merges_agree(own):
    rnd = random.Random(9)
    for _ in range(300):
        piece = "".join(rnd.choice("the aeiou rstln'é") for _ in range(rnd.randrange(2, 90))).encode()
        assert own._merge_short([own.single[b] for b in piece]) == own._merge_long([own.single[b] for b in piece])


def test_any_ids_decode_as_the_library_does(library, own):
    rnd = random.Random(11)
    for _ in range(300):
        some = [rnd.randrange(50_257) for _ in range(rnd.randrange(12))]
        assert own.decode(struct.pack(f"<{len(some)}I", *some)) == library.decode(some, skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode(struct.pack("<I", 50_257))


def test_frames(spark, library):
    rows = [(1, "It's a\n\n test", "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (None, "It's a\n\n test", "x", "y"), (4, "ab " * 400_000, "x", "y"), (5, "a<|endoftext|>b", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in B.round_trip_digests(docs, PATH).collect()}
    for doc_id, text, *_ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    coded = B.encode(docs, PATH)
    assert {r["doc_id"]: r["text"] for r in B.decode(coded, PATH).collect()} == {i: t or "" for i, t, *_ in rows}
    assert all(len(r["offsets"]) == len(r["ids"]) + 1 and r["offsets"][0] == 0 for r in coded.collect())
    assert B.round_trip_digests(docs.limit(0), PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    import json

    file = json.load(open(PATH, encoding="utf-8"))
    file["model"]["byte_fallback"] = True
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        B.Tokenizer(str(tmp_path / "other.json"))
