"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch's texts are laid end to end as code points. A table gives each code point a class, and a few
shifted comparisons turn the classes into nine symbols that say all that the next two characters can
matter (white space before text, a contraction's apostrophe, ...). The pre-tokeniser is then an
automaton of eight states over these symbols. Each symbol is a function from states to states, and
composing functions is associative, so states are found by a blocked prefix scan over a small
composition table: all blocks advance side by side, then the blocks' totals are scanned, then every
position gets its state. Token boundaries follow from (state, symbol) by table. No regex is run.

The slices between boundaries are merged pair by pair by rank; merged slices are kept in a bounded
cache. Each token's length in bytes is known from its id, so the byte offsets of a text's tokens are
the running sum of lengths, and decoding gathers the vocabulary's bytes for all ids at once.

Letters and numbers are those of Unicode 16.0, as in the tokenizer's own library: Python's table, with
what 16.0 added where Python's is older. The finished table is checked against its digest, so that
another Python raises an error and does not give other ids.

The vocabulary file is read by the driver's path and sent to the executors by Spark.

Defined results: a null text is encoded like an empty one (no ids); ids outside of the vocabulary raise
an error; a text of any length is encoded whole; equal texts have equal ids; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# Character classes.
OTHER, LETTER, NUMBER, SPACE, BLANK, APOS = range(6)  # SPACE: U+0020; BLANK: other white space
#: Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that an apostrophe opens, with its own length.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")

#: Letters and numbers that Unicode 16.0 has beyond 15.1, as first and last code points.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Fixed value: SHA-256 of the classes (0 other, 1 letter, 2 number) of all code points.
CLASSES_SHA256 = "f8f427506a2760101bde8049cdb38b50ad92853242a0935c587ec3724ddc8621"

# Symbols of the automaton.
CUT, SYM_L, SYM_N, SYM_O, SYM_A2, SYM_A3, LAST_SPACE, LAST_BLANK, INNER_WS = range(9)
# States: what stands to the left.
FRESH, AFTER_SPACE, IN_L, IN_N, IN_O, IN_WS, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8
BLOCK = 256
CACHE_SLICES, CACHE_BYTES = 150_000, 48


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            table[first : last + 1] = kind
    if hashlib.sha256(table.tobytes()).hexdigest() != CLASSES_SHA256:
        raise RuntimeError(f"the letters of Unicode {unicodedata.unidata_version} are not those that the tokenizer knows")
    table[list(WHITE_SPACE)] = BLANK
    table[0x20] = SPACE
    table[ord("'")] = APOS
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at the symbol."""
    if symbol == CUT:
        return FRESH, True
    if symbol == SYM_L and state in (ONE_LEFT, TWO_LEFT):
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (SYM_L, SYM_N, SYM_O):
        into = {SYM_L: IN_L, SYM_N: IN_N, SYM_O: IN_O}[symbol]
        return into, state not in (AFTER_SPACE, into)
    if symbol in (SYM_A2, SYM_A3):
        if state in (AFTER_SPACE, IN_O):
            return IN_O, False
        return (ONE_LEFT if symbol == SYM_A2 else TWO_LEFT), True
    if symbol == INNER_WS:
        return IN_WS, state != IN_WS
    return (AFTER_SPACE if symbol == LAST_SPACE else FRESH), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function id by symbol, composition table, state by (function, start state), starts by (state, symbol)."""
    functions = [tuple(_step(s, y)[0] for s in range(N_STATES)) for y in range(9)]
    known = {tuple(range(N_STATES)): 0}
    for f in functions:
        known.setdefault(f, len(known))
    while True:  # close the set under composition
        found = {tuple(g[f[s]] for s in range(N_STATES)) for f in known for g in known} - known.keys()
        if not found:
            break
        for f in sorted(found):
            known[f] = len(known)
    order = sorted(known, key=known.get)
    then = np.array([[known[tuple(g[f[s]] for s in range(N_STATES))] for g in order] for f in order], np.uint16)
    starts = np.array([[_step(s, y)[1] for y in range(9)] for s in range(N_STATES)])
    return np.array([known[f] for f in functions], np.uint16), then, np.array(order, np.uint8), starts


def scan_states(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before every symbol, from FRESH, by a blocked associative scan."""
    of, then, apply, _ = automaton()
    n = len(symbols)
    rows = -(-n // BLOCK)
    f = np.zeros(rows * BLOCK, np.uint16)  # 0: the identity
    f[:n] = of[symbols]
    f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)  # all blocks advance side by side
    width = len(then)
    flat = then.ravel()
    for j in range(1, BLOCK):
        f[j] = flat[f[j - 1].astype(np.int32) * width + f[j]]
    entry = np.zeros(rows, np.uint8)  # the state at which each block is entered
    if rows > 1:
        total, reach = f[-1].copy(), 1
        while reach < rows:  # scan the blocks' totals, doubling the reach
            total[reach:] = flat[total[:-reach].astype(np.int32) * width + total[reach:]]
            reach *= 2
        entry[1:] = apply[total[:-1], FRESH]
    after = apply[f, entry[None, :]].T.ravel()
    return np.r_[np.uint8(FRESH), after[: n - 1]] if n else after[:0]


def token_starts(codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where tokens start, over code points in which ``cuts`` marks the separators between texts."""
    kind = class_table()[codes]
    kind_next = np.r_[kind[1:], np.uint8(BLANK)]
    cut_next = np.r_[cuts[1:], True]
    is_ws = (kind == SPACE) | (kind == BLANK)
    last = is_ws & ~cut_next & (kind_next != SPACE) & (kind_next != BLANK)
    symbols = np.array([SYM_O, SYM_L, SYM_N, INNER_WS, INNER_WS, SYM_O], np.uint8)[kind]
    symbols[last & (kind == SPACE)] = LAST_SPACE
    symbols[last & (kind == BLANK)] = LAST_BLANK
    at = np.flatnonzero(kind == APOS)
    if len(at):
        padded = np.r_[np.where(cuts, 0, codes), 0, 0]
        one, two = padded[at + 1], padded[at + 2]
        symbols[at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SYM_A2
        for a, b in LONG_ENDINGS:
            symbols[at[(one == ord(a)) & (two == ord(b))]] = SYM_A3
    symbols[cuts] = CUT
    return automaton()[3][scan_states(symbols), symbols]


class Vocabulary:
    """Ranks of byte strings, read from a rank file (base64 bytes and rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for b, r in self.ranks.items():
            by_id[r] = b
        self.lengths = np.array([len(b) for b in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 96:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, in n log n."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts at i; 0: merged away
        before, heap = list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _ids(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        whole = "\n".join(t or "" for t in texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        cuts = np.zeros(len(codes), bool)
        cuts[stops] = True
        at = np.flatnonzero(token_starts(codes, cuts))  # separators are slices of their own
        marks = np.searchsorted(at, stops).tolist()
        edges = [*at.tolist(), len(codes)]
        get, ids, out, first = self.cache.get, self._ids, [], 0
        for mark in marks:
            pieces = [whole[a:b] for a, b in zip(edges[first:mark], edges[first + 1 : mark + 1])]
            out.append(b"".join([get(p) or ids(p) for p in pieces]))
            first = mark + 1
        return out

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each token starts in the text's bytes, and at the end the number of bytes."""
        return np.r_[0, np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text; any byte string can come out, so it is not decoded further."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(tokens) and tokens.max() >= len(self.lengths):
            raise ValueError("an id is outside of the vocabulary")
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[tokens] - (ends - n), n) + np.arange(n.sum())].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Texts are encoded in groups of about so many characters, which bounds the working arrays.
GROUP_CHARS = 1 << 20


def _groups(column: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for x in column:
        group.append(x.as_py())
        size += len(group[-1] or "")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _sent(spark: SparkSession, path: str) -> str:
    """The name under which the executors find a file that the driver has."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and offsets (byte offset of each token, then the text's length) of every text."""

    name = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for b in batches:
            done = 0
            for texts in _groups(b.column(1)):
                coded = vocab.encode(texts)
                ids = pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32()))
                offs = pa.array([vocab.offsets(c) for c in coded], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), ids, offs], ["doc_id", "ids", "offsets"])
                done += len(texts)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of ids; null ids stay null."""

    name = _sent(coded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for b in batches:
            out = [None if x is None else vocab.decode(np.array(x, "<i4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    ship(coded.sparkSession)
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes every text and decodes its ids again; only the digests leave the task."""

    name = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            done = 0
            for texts in _groups(b.column(1)):
                coded = vocab.encode(texts)
                columns = [
                    b.column(0).slice(done, len(texts)),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([sha(c) for c in coded]),
                    pa.array([sha(vocab.decode(c)) for c in coded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(texts)

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
