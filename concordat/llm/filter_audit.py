"""Audit of how filters interact: what each removes under every order in which they can be applied.

Each document has a mask of the filters that it fails. A table of all 32 masks by all 120 orders has the
step at which a document of that mask is removed, so that no filter is run more than once. Texts are read
once: a task counts words, distinct words, capitals and symbols over the bytes and gives a mask and a
digest. A text's copies are found by digest; the smallest id of each digest is joined back by (digest, id),
which deals a digest's copies to many tasks. Masks are counted by part and label before they are expanded,
and a task then adds up part, order and step removals by label with ``np.bincount``; Spark sums the arrays.

Defined results: a null text is empty, and equal to an empty one; a null part is the empty string; a row
without an id never fails E, makes no other row fail it, and has no labels; rows that repeat an id are
documents each, and none of the rows with a text's smallest id fails E; of several labels of an id one
that says 1 is enough, null labels say nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import durable

#: Filters in the order of a mask's bits, and every order of them.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Labels of a document: good adds 1, toxic adds 2.
LABELS = 4
#: A text is split into words in pieces of about so many bytes.
PIECE = 1 << 20
#: So many parts are held by a task before they are given on.
HELD_PARTS = 512

MARKED = "doc_id long, part string, mask int, digest binary"
COUNTED = "part string, filter_order string, step int, removed long, good_lost long, toxic_lost long, failing long, unique_fails long, total long"

_SYMBOL = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def first_failures() -> np.ndarray:
    """By mask and order: the step (from 0) at which such a document is removed; ``STEPS``: never."""
    bit = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (np.arange(1 << STEPS)[:, None, None] >> bit) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def _word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words, with a piece's words held at a time and the distinct ones."""
    if len(text) <= PIECE:
        found = text.split()
        return len(found), len(set(found))
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + PIECE, len(text)))
        stop = cut.start() if cut else len(text)
        found = text[at:stop].split()  # of bytes, split() knows exactly the six characters
        n, at = n + len(found), stop
        seen.update(found)
    return n, len(seen)


def mask_of(text: bytes, code_points: int) -> int:
    """The filters A to D that a text fails, as bits."""
    n, distinct = _word_counts(text)
    upper = len(text.translate(None, _NOT_UPPER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * code_points) << 2 | (_SYMBOL.search(text) is not None) << 3


def mark(docs: DataFrame, part: str = "source") -> DataFrame:
    """``MARKED`` for every row of ``docs`` (doc_id, text and the column of parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(2), "")
            points = pc.utf8_length(texts).to_pylist()
            masks, digests = [], []
            for text, n in zip(texts.cast(pa.binary()), points):
                raw = text.as_py()
                masks.append(mask_of(raw, n))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    return rows.mapInArrow(run, MARKED)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial ``COUNTED`` arrays of rows of part, mask, label and n."""
    table, width = first_failures(), 1 << STEPS
    step_bit = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    bits = (np.arange(width)[:, None] >> np.arange(STEPS)) & 1
    held: dict[str, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for part, by_mask in held.items():  # by_mask: mask by label
            at = np.flatnonzero(by_mask.ravel())
            n = by_mask.ravel()[at]
            mask, label = np.divmod(at, LABELS)
            cell = (np.arange(len(ORDERS)) * (STEPS + 1) + table[mask]) * LABELS + label[:, None]
            size = len(ORDERS) * (STEPS + 1) * LABELS
            exact = lambda low: np.bincount(cell.ravel(), np.repeat(low, len(ORDERS)).astype(np.float64), size).astype(np.int64)
            # Weights are floats: in halves of 26 bits their sums are exact.
            removed = (exact(n & 0x3FFFFFF) + (exact(n >> 26) << 26)).reshape(len(ORDERS), STEPS + 1, LABELS)[:, :STEPS]
            all_labels = by_mask.sum(axis=1)
            failing, only = all_labels @ bits, all_labels[1 << np.arange(STEPS)]
            columns = [
                pa.array([part] * (len(ORDERS) * STEPS)),
                pa.array([o for o in ORDERS for _ in range(STEPS)]),
                pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32()),
                *(pa.array(v.ravel()) for v in (removed.sum(axis=2), removed[:, :, [1, 3]].sum(axis=2), removed[:, :, [2, 3]].sum(axis=2), failing[step_bit], only[step_bit])),
                pa.array(np.full(len(ORDERS) * STEPS, all_labels.sum())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in COUNTED.split(", ")])
        held.clear()

    for b in batches:
        masks, labels, n = (b.column(k).to_numpy() for k in (1, 2, 3))
        for part, m, label, count in zip(b.column(0).to_pylist(), masks.tolist(), labels.tolist(), n.tolist()):
            if part not in held:
                if len(held) >= HELD_PARTS:
                    yield from given()
                held[part] = np.zeros((width, LABELS), np.int64)
            held[part][m, label] += count
    yield from given()


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask (all five filters), label and n: how many rows are alike in these."""
    alike = mark(docs, part).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = durable(alike)  # read twice below, and texts once
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((says("quality") + 2 * says("toxic")).alias("label"))
    # min leaves out null ids; where a text has no other row, none of its rows fails E.
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    named = rows.filter("doc_id IS NOT NULL").join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    named = named.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(16)).alias("mask"), F.coalesce("label", F.lit(0)).alias("label"), "n")
    nameless = rows.filter("doc_id IS NULL").select("doc_id", "part", "mask", F.lit(0).alias("label"), "n")
    return named.unionByName(nameless)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for a part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masks = document_masks(docs, labels, part).groupBy("part", "mask", "label").agg(F.sum("n").alias("n"))
    # 128 rows for a part at most, which meet so that a part is expanded once.
    counted = masks.repartition("part").mapInArrow(_count, COUNTED)
    sums = counted.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost", "failing", "unique_fails", "total")))
    gone = F.transform(F.col("steps"), lambda s: s["removed"])
    ordered = sums.groupBy("part", "filter_order").agg(F.array_sort(F.collect_list(F.struct("step", "removed", "good_lost", "toxic_lost", "failing", "unique_fails", "total"))).alias("steps"))
    rows = ordered.select("part", "filter_order", F.explode(F.transform("steps", lambda s, k: s.withField("kept", s["total"] - F.aggregate(F.slice(gone, 1, k + 1), F.lit(0).cast("long"), lambda a, x: a + x)))).alias("s"))
    rows = rows.select("part", "filter_order", "s.*", F.substr("filter_order", "s.step", F.lit(1)).alias("filter"))
    shapley = sums.groupBy("part", F.substr("filter_order", "step", F.lit(1)).alias("filter")).agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "filter"]).select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
