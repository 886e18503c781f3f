"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text is cut into tokens: runs of letters and digits, and runs of punctuation. Four kinds of n-grams
are hashed into one weight vector: tokens, pairs of tokens, pairs of token shapes (lower, title, upper,
digits, or the punctuation itself), and pairs marked as seen earlier in the same text. A feature's
value is its share of the text's tokens, so the score is a sparse dot product, read in one pass over
the text with array operations on bytes.

Training takes at most ``MAX_TRAIN_ROWS`` labelled documents that exist (those with the smallest hash of
their id) and at most ``MAX_TRAIN_FEATURES`` non-zero values of them, in the order of that hash, through
per-coordinate follow-the-regularised-leader updates in one task. One text counts for an id, and values
beyond the bound are left out before that task, so that it holds 160 MB of values at most. Only the
finished weights (a fixed 2 MB) come to the driver and are broadcast. Everything is scored, whole.

Defined results: null and blank texts have no features and score the model's bias; repeated labels of a
document count as good if any does; of different texts under one labelled id the one with the smallest
hash is learnt from, all are scored; labels without a document or with a null id or quality are ignored;
rows with a null id are scored and never held out; without labels of both classes the score is the
smoothed share of good labels (0.5 with none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import durable

DIM_BITS = 18
DIM = 1 << DIM_BITS
MAX_TRAIN_ROWS = 8_000
MAX_TRAIN_FEATURES = 20_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 1e-4, 1e-4
#: Feature values are shares of a text's tokens times this.
SCALE = 8.0
#: Texts are read in chunks of so many bytes, which bounds the arrays besides one hash for each token.
CHUNK = 1 << 19
#: Texts are taken from a batch in groups of about so many bytes, so that only a group's arrays are held at a time.
GROUP = 1 << 18

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64

_POWERS = np.cumprod(np.r_[_U(1), np.full(CHUNK + 64, _P, np.uint64)])
_INVERSE = np.cumprod(np.r_[_U(1), np.full(CHUNK + 64, _P_INV, np.uint64)])
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 punctuation
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and shape code of every token of at most CHUNK bytes."""
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    change = np.r_[True, kind[1:] != kind[:-1], True]
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    own = kind[starts] > 0
    starts, ends = starts[own], ends[own]
    sums = np.r_[_U(0), np.cumsum((b.astype(np.uint64) + _U(1)) * _POWERS[: len(b)])]
    h = _mix((sums[ends] - sums[starts]) * _INVERSE[starts])
    counts = lambda lo, hi: np.r_[0, np.cumsum((b >= lo) & (b <= hi))]
    lower, upper, digit = counts(97, 122), counts(65, 90), counts(48, 57)
    has = lambda c: c[ends] > c[starts]
    shape = has(lower).astype(np.uint64) + _U(2) * has(upper) + _U(4) * has(digit) + _U(8) * (b[starts] - 65 < 26)
    return starts, h, np.where(kind[starts] == 2, h, shape)


def _long_token(data: bytes, at: int) -> tuple[int, int, int]:
    """End, hash and shape code of the token that starts at ``at``, read in steps: the same as of ``_tokens``."""
    kind, total, power, shape = _KIND[data[at]], 0, 1, 8 * (65 <= data[at] <= 90)
    end = at
    while end < len(data):
        b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - end), end)
        other = np.flatnonzero(_KIND[b] != kind)
        b = b[: other[0]] if len(other) else b
        part = int(((b.astype(np.uint64) + _U(1)) * _POWERS[: len(b)]).sum(dtype=np.uint64)) if len(b) else 0
        total = (total + part * power) & (2**64 - 1)
        power = power * pow(_P, len(b), 2**64) & (2**64 - 1)
        for bit, lo, hi in ((1, 97, 122), (2, 65, 90), (4, 48, 57)):
            shape |= bit * bool(((b >= lo) & (b <= hi)).any())
        end += len(b)
        if len(other):
            break
    h = int(_mix(np.array([total], np.uint64))[0])
    return end, h, h if kind == 2 else shape


def _token_end(data: bytes, at: int, stop: int) -> int:
    """The last place after ``at`` and up to ``stop`` where a token or white space ends; ``at`` if there is none."""
    kind = _KIND[np.frombuffer(data, np.uint8, min(len(data), stop + 1) - at, at)]
    ends = np.flatnonzero(kind[1:] != kind[:-1])
    return at + int(ends[-1]) + 1 if len(ends) else at


def _runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document numbers, hashes and shape codes of all tokens in order, read in chunks that never cut a token."""
    data, docs, offs, size = [], [], [], 0

    def read() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, h, shape = _tokens(b"\n".join(data))
        return np.asarray(docs)[np.searchsorted(offs, starts, "right") - 1], h, shape

    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            if size and len(t) - at > CHUNK - size - 1:  # start a new chunk
                yield read()
                data, docs, offs, size = [], [], [], 0
            stop = len(t)
            if stop - at > CHUNK - 1:
                stop = _token_end(t, at, at + CHUNK - 1)
                if stop == at:  # one token fills the chunk, or one run of white space
                    blank = _KIND[t[at]] == 0
                    at, h, shape = _long_token(t, at)
                    if not blank:
                        yield np.array([i]), np.array([h], np.uint64), np.array([shape], np.uint64)
                    continue
            data.append(t[at:stop])
            docs.append(i)
            offs.append(size)
            size += stop - at + 1
            at = stop
    if data:
        yield read()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number and index of every n-gram occurrence, and the number of tokens of every document."""
    runs = list(_runs(texts))
    if not sum(len(d) for d, _, _ in runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    doc, h, shape = (np.concatenate(x) for x in zip(*runs))
    same = doc[1:] == doc[:-1]
    pair = _mix(h[:-1] * _U(0xC2B2AE3D27D4EB4F) + h[1:])[same]
    shapes2 = _mix(shape[:-1] * _U(0x165667B19E3779F9) + shape[1:] + _U(77))[same]
    of_pair = doc[1:][same]
    # a pair that its text has had before
    keyed = pair ^ _mix(of_pair.astype(np.uint64) + _U(1))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(pair), bool)
    again[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    mask = _U(DIM - 1)
    index = np.concatenate([h & mask, pair & mask, shapes2 & mask, np.full(int(again.sum()), 4711, np.uint64)]).astype(np.int64)
    return np.concatenate([doc, of_pair, of_pair, of_pair[again]]), index, np.bincount(doc, minlength=len(texts))


def _encode(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _pieces(texts, most: int = GROUP) -> Iterator[tuple[int, list[bytes]]]:
    """Groups of whole texts of about ``most`` characters, encoded, with the number of the first."""
    first, size, group = 0, 0, []
    for i, t in enumerate(texts):
        group += _encode([t])
        size += len(group[-1])
        if size >= most:
            yield first, group
            first, size, group = i + 1, 0, []
    if group:
        yield first, group


def dots(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = []
    for _, group in _pieces(texts):
        doc, index, n = features(group)
        out.append(np.bincount(doc, weights[index], len(group)) * (SCALE / np.maximum(n, 1)))
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z + bias, -35, 35)))


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, indices, values) in the given order; weights and bias."""
    good = sum(y for y, _, _ in examples)
    prior = np.log((good + 1) / (len(examples) - good + 1))
    if good in (0, len(examples)):
        return np.zeros(DIM), float(prior)
    z, n, bias, bias_n = np.zeros(DIM), np.zeros(DIM), float(prior), 1.0
    for _ in range(EPOCHS):
        for y, i, x in examples:
            x = x.astype(np.float64)
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
            g = (p - y) * x
            n[i] = ni + g * g
            z[i] = zi + g - (np.sqrt(n[i]) - root) / ALPHA * w
            bias_n += (p - y) ** 2
            bias -= 0.05 / np.sqrt(bias_n) * (p - y)
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, float(bias)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, group in _pieces(x.as_py() for x in b.column(2)):
            doc, index, n = features(group)
            key, counts = np.unique(doc * DIM + index, return_counts=True)
            cut = np.searchsorted(key, np.arange(len(group) + 1) * DIM)
            idx = [(key[a:z] % DIM).astype("<i4").tobytes() for a, z in zip(cut, cut[1:])]
            val = [(counts[a:z] * SCALE / max(m, 1)).astype("<f4").tobytes() for a, z, m in zip(cut, cut[1:], n)]
            part = b.slice(first, len(group))
            n_values = pa.array((cut[1:] - cut[:-1]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n_values, pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["at", "label", "n_values", "idx", "val"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(*(c.to_pylist() for c in b.columns))
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    weights, bias = fit([(label, np.frombuffer(idx, "<i4"), np.frombuffer(val, "<f4")) for _, label, idx, val in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from a bounded sample of the labels that may be learnt from."""
    ship(docs.sparkSession)
    there = docs.select("doc_id").distinct()  # labels without a document take no place in the sample
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .join(there, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAIN_ROWS)  # the documented bound of the sample, and of what is broadcast below
        .select(F.col("doc_id").alias("__id"), "label")
    )
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(sample), own["doc_id"] == sample["__id"]).withColumn("h", F.xxhash64("text"))
    # One text for an id, whatever its repeats; each task passes on one row for an id at most.
    texts = texts.groupBy("__id", "label").agg(F.min(F.struct("h", "text"))["text"].alias("text")).select(F.xxhash64("__id").alias("at"), "label", "text")
    rows = durable(texts.mapInArrow(_examples, "at long, label int, n_values long, idx binary, val binary"))
    sizes = np.array(rows.select("at", "n_values").collect(), np.int64).reshape(-1, 2)  # at most MAX_TRAIN_ROWS numbers
    sizes = sizes[np.argsort(sizes[:, 0], kind="stable")]
    within = (sizes[:, 1].cumsum() <= MAX_TRAIN_FEATURES) | (np.arange(len(sizes)) == 0)
    if not len(sizes):
        return np.zeros(DIM), 0.0
    chosen = rows.filter(F.col("at") <= int(sizes[within, 0].max())).select("at", "label", "idx", "val")
    model = chosen.repartition(1).mapInArrow(_train, "weights binary, bias double").first()
    if model is None:
        return np.zeros(DIM), 0.0
    return np.frombuffer(model["weights"], "<f8"), model["bias"]


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A column function from text to score; the model is broadcast once."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias = shared.value
        return pd.Series(dots(texts, weights, bias))

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every document."""
    score = scorer(docs, train(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents that score at least ``least``, with their columns.

    The labels' texts are those of ``learn_from``, or of ``docs`` itself if there is none. Where ``docs`` has been
    filtered by quality already, the bad examples are only in the whole table.
    """
    score = scorer(docs, train(docs if learn_from is None else learn_from, labels))
    return docs.filter(score(F.col("text").cast("string")) >= least)
