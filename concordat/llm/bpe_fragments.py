"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside of no vocabulary token can never be merged over: between them there is
a certain cut, whatever surrounds it. All such pairs are found once from the vocabulary, as a table of
65,536. A batch's texts are laid end to end as bytes; one look-up of each adjacent pair marks the cuts,
to which the pre-tokeniser's own boundaries are added where the pair alone does not force one. The
fragments between cuts are encoded independently of each other and their ids concatenated, so a
fragment's ids are kept in a bounded cache by its bytes alone, and even a word of a million letters
falls into short pieces. Within a fragment the pair of lowest rank merges first, the leftmost of equals.

The tokenizer's file (JSON) gives the vocabulary, the merges and added tokens. Added tokens are taken out
of a text first, the leftmost and longest, and what lies between them is encoded as texts of its own.
The file is read by the driver's path and sent to the executors by Spark.

Defined results: a null text is encoded like an empty one (no ids); ids outside of the vocabulary raise an
error; decoding gives text, with U+FFFD for bytes that are no UTF-8; a text of any length is encoded
whole; equal texts have equal ids; an empty table gives an empty result; extra columns are ignored. A file
with another model than byte-level BPE, or options that would change ids, raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe import _groups, _sent, token_starts

CACHE_FRAGMENTS, CACHE_BYTES = 200_000, 64
#: Longer fragments are merged by a heap.
LONG = 64
NONE = 1 << 60


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it prints in Latin-1, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE of a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._check(file)
        letters, model = byte_letters(), file["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate((raw(x), raw(y)) for x, y in pairs)}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.never = np.ones(1 << 16, bool)
        for t in ids:
            if len(t) > 1:
                whole = np.frombuffer(t, np.uint8).astype(np.int32)
                self.never[whole[:-1] << 8 | whole[1:]] = False
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.find_added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        by_id = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for t, i in ids.items():
            by_id[i] = t
        for t, i in self.added.items():
            by_id[i] = raw(t) if all(c in letters for c in t) else t.encode()
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.known = self.lengths > 0
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def _check(file: dict) -> None:
        model, before = file["model"], file["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = before and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        exact = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"])
        if not (plain and level and exact and file["normalizer"] is None and file["decoder"]["type"] == "ByteLevel"):
            raise ValueError("the tokenizer's file is no plain byte-level BPE")

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment."""
        ids = [self.single[b] for b in fragment]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (NONE, -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none or best[0] == NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of (rank, place) over a linked list, where stale entries are passed over."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if (p := before[i]) >= 0 and (m := get((ids[p], ids[i]))):
                heapq.heappush(heap, (m[0], p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def _ids(self, fragment: bytes) -> bytes:
        out = np.array(self.merge(fragment), "<u4").tobytes()
        if len(fragment) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_FRAGMENTS:
                self.cache.clear()
            self.cache[fragment] = out
        return out

    def cuts(self, whole: str, raw: bytes, stops: np.ndarray) -> np.ndarray:
        """Where fragments begin in ``raw``, the bytes of ``whole``, whose code points ``stops`` are separators."""
        at = np.frombuffer(raw, np.uint8)
        begins = np.zeros(len(at), bool)
        begins[1:] = self.never[at[:-1].astype(np.int32) << 8 | at[1:]]
        separators = np.zeros(len(whole), bool)
        separators[stops] = True
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        leads = np.flatnonzero((at & 0xC0) != 0x80)
        begins[leads[token_starts(codes, separators)]] = True
        return np.flatnonzero(begins)

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        whole = "\n".join(texts) + "\n"
        raw = whole.encode("utf-8", "surrogatepass")
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        edges = self.cuts(whole, raw, stops)
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
        marks = np.searchsorted(edges, np.cumsum(np.array(sizes) + 1) - 1).tolist()
        edges = [*edges.tolist(), len(raw)]
        get, ids, out, first = self.cache.get, self._ids, [], 0
        for mark in marks:  # a separator is a fragment of its own
            fragments = [raw[a:b] for a, b in zip(edges[first:mark], edges[first + 1 : mark + 1])]
            out.append(b"".join([get(f) or ids(f) for f in fragments]))
            first = mark + 1
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        plain, whole = [], []  # whole: what a text consists of, plain texts by number and added ids
        for t in texts:
            t, at, own = t or "", 0, []
            for m in self.find_added.finditer(t):
                own += [(len(plain), None), (None, self.added[m[0]])]
                plain.append(t[at : m.start()])
                at = m.end()
            own.append((len(plain), None))
            plain.append(t[at:])
            whole.append(own)
        coded = self._plain(plain)
        return [b"".join(coded[k] if k is not None else added.to_bytes(4, "little") for k, added in own) for own in whole]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each token starts in the text's bytes, and at the end the number of bytes."""
        return np.r_[0, np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(tokens) and (tokens.max() >= len(self.lengths) or not self.known[tokens].all()):
            raise ValueError("an id is outside of the vocabulary")
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        raw = self.bytes[np.repeat(self.starts[tokens] - (ends - n), n) + np.arange(n.sum())].tobytes()
        return raw.decode("utf-8", "replace")


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _mapped(docs: DataFrame, path: str, columns, schema: str) -> DataFrame:
    """``columns(tokenizer, texts)`` beside the id of every row, in groups of bounded size."""
    name = _sent(docs.sparkSession, path)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(SparkFiles.get(name))
        for b in batches:
            done = 0
            for texts in _groups(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), *columns(own, texts)], names)
                done += len(texts)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (byte offset of each token, then the text's length) of every text."""

    def columns(own: Tokenizer, texts: list[str | None]) -> list[pa.Array]:
        coded = own.encode(texts)
        return [pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())), pa.array([own.offsets(c) for c in coded], pa.list_(pa.int64()))]

    return _mapped(docs, path, columns, "doc_id long, ids array<int>, offsets array<long>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids stay null."""
    name = _sent(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(SparkFiles.get(name))
        for b in batches:
            out = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    ship(coded.sparkSession)
    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text and decodes its ids again; only the digests leave the task."""

    def columns(own: Tokenizer, texts: list[str | None]) -> list[pa.Array]:
        coded = own.encode(texts)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([sha(c) for c in coded]), pa.array([sha(own.decode(c).encode()) for c in coded])]

    return _mapped(docs, path, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
