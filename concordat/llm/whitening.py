"""Embedding whitening from exact integer covariances, by products of digit slices.

An entry c becomes the integer x = floor(1024 * c) + 100000. For the covariance the integers of a block of
vectors are split into limbs of ``LIMB`` bits; a product of two limb matrices is a float64 BLAS product
whose sums stay under 2^53 and so are exact. Products are gathered by their shift as 64-bit integers,
recombined as big integers at a task's end, and leave the task as 32-bit digits, one row for an entry of
the triangle; Spark sums the digits of all tasks, in which nothing can overflow. The driver gets the
summed triangles alone (at most ``MAX_CELLS`` entries, whatever the number of vectors), forms

    n * sum(x x') - S S'  =  n^2 * V

without rounding, which is the centred covariance as if it had been centred before multiplying, rounds each
entry once and decomposes it. Eigenvectors are then refined against the covariance in extended precision
(the iteration of Ogita and Aishima, 2018), so that small components beside large ones are right too. A
second pass over the vectors measures the covariance of what comes out, a third one gives the rows.

Defined results: vectors that are null or hold a null or non-finite entry are dropped, zero vectors stay;
vectors of different lengths are fitted apart, each length with its own n, S and components; 1024 * c is
held to +-2^62; ids are carried only, so null and repeated ids stay and each row counts; a component with
no variance (an eigenvalue not over 1e-17 of the trace) has null for ``whitened`` and takes no part in
``identity_error``, which is null if none has any; ``explained`` is null if the trace is zero; ``deviation``
is null where it is no long; an empty vector has no components and so no rows; an empty table gives no
rows; extra columns are ignored. Lengths that would need more than ``MAX_CELLS`` entries together (one of
2,895, for example) raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**62
#: Bits of a limb, and rows of a block: 2 * LIMB + log2(BLOCK) bits at most are added up in a float64 of 53.
LIMB, BLOCK = 16, 1 << 14
#: Values of one block's matrix.
BLOCK_VALUES = 1 << 22
#: Blocks whose products an int64 holds with certainty.
FOLD = 1 << 10
DIGIT, DIGITS = 32, 6
MAX_CELLS = 1 << 22
COMPONENTS = 8
#: An eigenvalue of at most this part of the trace counts as zero.
NO_VARIANCE = 1e-17

FOUND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that remain."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def integers(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch's vectors, for each length in parts of bounded size: the row numbers and the integers."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        step = max(1, min(BLOCK, BLOCK_VALUES // d))
        for k in range(0, len(at), step):
            rows = at[k : k + step]
            yield rows, integers(flat[starts[rows][:, None] + np.arange(d)])


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as float64 limbs, the lowest first; the last one has the sign."""
    top, out = int(max(x.max(), -x.min(), 0)), []
    while top >> LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, top = x >> LIMB, top >> LIMB
    return [*out, x.astype(np.float64)]


class Gram:
    """The number, sums and products of integer vectors of one length."""

    def __init__(self, d: int):
        self.d, self.n, self.blocks = d, 0, 0
        self.sums: np.ndarray = np.zeros(d, object)
        self.products: np.ndarray = np.zeros((d, d), object)
        self.shifted: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> None:
        parts = limbs(x)
        for i, a in enumerate(parts):
            self.sums += a.sum(axis=0).astype(np.int64).astype(object) << (LIMB * i)
            for j in range(i, len(parts)):
                p = (a.T @ parts[j]).astype(np.int64)
                held = self.shifted.setdefault(i + j, np.zeros((self.d, self.d), np.int64))
                held += p if i == j else p + p.T
        self.n, self.blocks = self.n + len(x), self.blocks + 1
        if self.blocks % FOLD == 0:
            self.fold()

    def fold(self) -> None:
        for s, p in self.shifted.items():
            self.products += p.astype(object) << (LIMB * s)
        self.shifted.clear()

    def cells(self) -> pa.RecordBatch:
        """size, i, j and digits: the number at (-1, -1), sums at (i, -1), products at (i, j) with i <= j."""
        self.fold()
        i, j = np.triu_indices(self.d)
        ordinal = np.arange(self.d)
        values = np.concatenate([np.array([self.n], object), self.sums, self.products[i, j]])
        places = [np.r_[-1, ordinal, i], np.r_[-1, -np.ones(self.d, int), j]]
        columns = [pa.array(np.full(len(values), self.d), pa.int32()), *(pa.array(p, pa.int32()) for p in places)]
        for _ in range(DIGITS - 1):
            columns.append(pa.array((values & ((1 << DIGIT) - 1)).astype(np.int64)))
            values = values >> DIGIT
        columns.append(pa.array(values.astype(np.int64)))
        return pa.RecordBatch.from_arrays(columns, ["size", "i", "j", *DIGIT_NAMES])


DIGIT_NAMES = [f"digit_{k}" for k in range(DIGITS)]


def _count_cells(d: int) -> int:
    return 1 + d + d * (d + 1) // 2


def _refuse(cells: int) -> None:
    if cells > MAX_CELLS:
        raise ValueError(f"covariances of {cells} entries are wanted, over {MAX_CELLS}: reduce the vectors' lengths first")


def _partial_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[int, Gram] = {}
    for b in batches:
        for _, x in _blocks(b.column(0)):
            d = x.shape[1]
            if d not in grams:
                _refuse(_count_cells(d) + sum(map(_count_cells, grams)))
                grams[d] = Gram(d)
            grams[d].add(x)
    for g in grams.values():
        yield g.cells()


@dataclass
class Model:
    """What was fitted to the vectors of one length."""

    n: int
    sums: np.ndarray
    """Big integers."""
    weights: np.ndarray
    """A column for each component: the eigenvector over the root of its eigenvalue, NaN without variance."""
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, without rounding."""
        if (int(np.abs(x).max()) + 1) * self.n < 1 << 61 and max(map(abs, self.sums.tolist())) < 1 << 61:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.weights


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares over the dimensions, without rounding; None for what is no long."""
    if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
        return (centred**2).sum(axis=1).tolist()
    whole = (centred.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in whole]


def _extended(v: np.ndarray) -> np.ndarray:
    """Big integers in extended precision, rounded once."""
    high = v.astype(np.float64)
    rest = v - np.vectorize(int, otypes=[object])(high)
    return high.astype(np.longdouble) + rest.astype(np.float64).astype(np.longdouble)


def eigen(v: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in extended precision."""
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x.astype(np.longdouble)
    one = np.eye(len(v), dtype=np.longdouble)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ v @ x
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.linalg.norm((s - np.diag(e)).astype(np.float64)) * np.finfo(np.float64).eps + np.finfo(np.longdouble).eps * float(np.abs(e).max()) * len(v))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    e = np.diag(x.T @ v @ x) / np.diag(x.T @ x)
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order] / np.sqrt((x**2).sum(axis=0))[order]


def fit(n: int, sums: np.ndarray, products: np.ndarray) -> Model:
    """The components of big-integer sums and products of ``n`` vectors."""
    spread = products * n - np.outer(sums, sums)  # n^2 * V
    trace = sum(int(spread[i, i]) for i in range(len(sums)))
    k = min(COMPONENTS, len(sums))
    if not trace:
        return Model(n, sums, np.full((len(sums), k), np.nan), np.full(k, np.nan))
    # As parts of the trace, so that no size of number matters.
    bits = max(0, trace.bit_length() - 1000)
    e, x = eigen(_extended(spread >> bits) / np.longdouble(float(trace >> bits)))
    root = np.sqrt(np.where(e > NO_VARIANCE, e, np.nan).astype(np.longdouble)[:k])
    unit = np.sqrt(np.longdouble(float(trace >> bits))) * np.longdouble(2.0) ** (np.longdouble(bits) / 2) / n
    return Model(n, sums, (x[:, :k] / (root * unit)).astype(np.float64), np.maximum(e[:k], 0).astype(np.float64))


def models(rows: DataFrame) -> dict[int, Model]:
    """Fits by length; only the summed triangles reach the driver."""
    digits = ", ".join(f"{c} long" for c in DIGIT_NAMES)
    parts = rows.select("vector").mapInArrow(_partial_grams, f"size int, i int, j int, {digits}")
    whole = parts.groupBy("size", "i", "j").agg(*(F.sum(c).alias(c) for c in DIGIT_NAMES)).toArrow()
    size, i, j = (whole.column(c).to_numpy() for c in ("size", "i", "j"))
    value = sum((whole.column(c).to_numpy().astype(object) << (DIGIT * k) for k, c in enumerate(DIGIT_NAMES)), np.zeros(len(size), object))
    _refuse(len(size))
    out = {}
    for d in np.unique(size).tolist():
        own = size == d
        at, to, v = i[own], j[own], value[own]
        sums, products = np.zeros(d, object), np.zeros((d, d), object)
        sums[at[(at >= 0) & (to < 0)]] = v[(at >= 0) & (to < 0)]
        pair = to >= 0
        products[at[pair], to[pair]] = products[to[pair], at[pair]] = v[pair]
        out[d] = fit(int(v[at < 0][0]), sums, products)
    return out


def _measured(rows: DataFrame, known) -> dict[int, float | None]:
    """By length: how far the covariance of the whitened vectors is from the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _blocks(b.column(0)):
                m = known.value[x.shape[1]]
                w = np.c_[np.ones(len(x)), m.whiten(m.centred(x))]  # the first row has the sums
                total[x.shape[1]] = total.get(x.shape[1], 0) + w.T @ w
        for d, t in total.items():
            i, j = np.indices(t.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t.ravel())], ["size", "i", "j", "v"])

    parts = rows.select("vector").mapInArrow(run, "size int, i int, j int, v double")
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("size", "i", "j").agg(F.sum("v").alias("v")).collect():  # 81 for a length
        sums.setdefault(r["size"], np.zeros((COMPONENTS + 1, COMPONENTS + 1)))[r["i"], r["j"]] = r["v"]
    out = {}
    for d, t in sums.items():
        n, k = t[0, 0], min(COMPONENTS, d)
        off = np.abs(t[1 : k + 1, 1 : k + 1] / n - np.outer(t[0, 1 : k + 1], t[0, 1 : k + 1]) / n**2 - np.eye(k))
        out[d] = float(np.nanmax(off)) if np.isfinite(off).any() else None
    return out


def whiten(vectors: DataFrame) -> DataFrame:
    """``FOUND``: of every remaining row of ``vectors`` (vec_id, embedding) its first components, whitened."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    fitted = models(rows)
    first = spark.sparkContext.broadcast(fitted)
    for d, error in _measured(rows, first).items():
        fitted[d].identity_error = error
    known = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _blocks(b.column(1)):
                m = known.value[x.shape[1]]
                centred = m.centred(x)
                w, k = m.whiten(centred), m.weights.shape[1]
                each = lambda v, kind: pa.array(np.repeat(v, k), kind)
                down = lambda v, kind: pa.array(np.tile(v, len(at)), kind, from_pandas=True)
                columns = [
                    b.column(0).take(each(at, pa.int64())),
                    down(np.arange(1, k + 1), pa.int32()),
                    down(np.full(k, m.n), pa.int64()),
                    pa.array([v for v in deviations(centred) for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    down(m.explained, pa.float64()),
                    pa.array([m.identity_error] * (k * len(at)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)
