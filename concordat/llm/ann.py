"""Nearest neighbours by a block matrix join with quantised distances and error bounds.

Queries are dealt into blocks and candidates into tiles of a bounded number of values; every block meets
every tile in one cell, whose two sides are brought together by a cogrouped shuffle. Nothing passes
through the driver but counts. Inside of a cell both sides are scaled to int8, a part's inner products
are one matrix product of the int8 values (carried in floats, where these integers are exact), and

    |d(q, c) - d(q', c')| <= |q - q'| + |c - c'|

bounds the distance by that of the quantised vectors and the two known quantisation errors. A pair is
dropped only if its lower bound exceeds the query's tenth upper bound so far, so no neighbour is lost
(recall is 1). Survivors are recomputed from the original vectors in double precision, and each query's
nearest are kept in a heap of ``k``, first by cell and then, merged, by query.

Each candidate is shuffled once for a block and each query once for a tile, against which a cell does
the work of all its pairs: thousands of operations for a byte moved, at any size.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part; a
query meets candidates of its own length only; equal distances go to the smaller vec_id; with fewer
candidates than ``k`` all are returned; rows that repeat a vec_id are separate candidates, of which
those with the query's id are left out; an empty table gives no rows. Extra columns are ignored. A query is a
distinct (vec_id, embedding): equal query rows count once, and different vectors under one id each get their
own ranks 1 to ``k`` (all under that query_id), told apart by ``query_row``, a number that is unique in a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import durable

#: Values (vectors x length) of a query block and of a candidate tile.
BLOCK_VALUES, TILE_VALUES = 1 << 21, 1 << 23
#: Tiles are made smaller than that, down to so many candidates, where there are fewer cells than shuffle partitions.
LEAST_CANDIDATES = 512
#: Elements of one distance matrix (queries x candidates).
TILE = 1 << 22
QUERY_TILE = 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(side: pa.Table) -> np.ndarray:
    """The vectors of a cell's side, which are of one length."""
    flat = side.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(side.num_rows, -1)


class Quantised:
    """int8 values of vectors, carried in floats that hold their inner products exactly, with scales and errors."""

    def __init__(self, x: np.ndarray):
        top = np.abs(x).max(axis=1)
        self.scale = top / 127
        self.q = np.rint(x / np.where(self.scale > 0, self.scale, 1)[:, None]).astype(np.int8)
        back = self.q * self.scale[:, None]
        self.error = np.sqrt(((x - back) ** 2).sum(axis=1)) + top * 1e-12
        self.square = (back**2).sum(axis=1)
        self.values = self.q.astype(np.float32 if x.shape[1] <= 1024 else np.float64)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed component by component so that equal vectors tie exactly."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += (q[:, k] - c[:, k]) ** 2
    return np.sqrt(total)


class Search:
    """The ``k`` nearest so far of every query of one length."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.numbers, self.ids, self.x, self.k, self.quant = numbers, ids, x, k, Quantised(x)
        self.best_d = np.full((len(ids), k), np.inf)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for q0 in range(0, len(self.ids), QUERY_TILE):
            rows = slice(q0, min(q0 + QUERY_TILE, len(self.ids)))
            step = max(1, TILE // (rows.stop - rows.start))
            for c0 in range(0, len(ids), step):
                self._tile(rows, ids[c0 : c0 + step], x[c0 : c0 + step])

    def _tile(self, rows: slice, ids: np.ndarray, x: np.ndarray) -> None:
        c, q = Quantised(x), self.quant
        dot = (q.values[rows] @ c.values.T) * q.scale[rows, None] * c.scale
        near = np.sqrt(np.maximum(q.square[rows, None] + c.square - 2 * dot, 0))
        slack = q.error[rows, None] + c.error + 1e-7 * np.sqrt(q.square[rows, None] + c.square)  # and rounding
        own = self.ids[rows, None] == ids
        upper = np.where(own, np.inf, near + slack)
        limit = self.best_d[rows, -1]
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        at, to = np.nonzero(~(near - slack > limit[:, None]) & ~own)
        for p in range(0, len(at), TILE // 8):  # survivors, in parts that fit memory
            self._merge(rows.start + at[p : p + TILE // 8], to[p : p + TILE // 8], ids, x)

    def _merge(self, at: np.ndarray, to: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(at):
            return
        d = exact(self.x[at], x[to])
        hit = np.unique(at)
        who = np.concatenate([at, np.repeat(hit, self.k)])
        d = np.concatenate([d, self.best_d[hit].ravel()])
        v = np.concatenate([ids[to], self.best_id[hit].ravel()])
        order = np.lexsort((v, d, who))
        who, d, v = who[order], d[order], v[order]
        first = np.searchsorted(who, hit)
        take = first[:, None] + np.arange(self.k)
        self.best_d[hit], self.best_id[hit] = d[take], v[take]

    def rows(self) -> pa.RecordBatch:
        found = self.best_id != np.iinfo(np.int64).max
        at = np.nonzero(found)[0]
        return pa.RecordBatch.from_arrays([pa.array(self.numbers[at]), pa.array(self.ids[at]), pa.array(self.best_id[found]), pa.array(self.best_d[found])], ["query_row", "query_id", "vec_id", "score"])


def _cell(k: int):
    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        numbers, ids = (asked.column(c).to_numpy() for c in ("query_row", "vec_id"))
        if not asked.num_rows or not there.num_rows:
            return pa.table({"query_row": numbers[:0], "query_id": ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})
        search = Search(numbers, ids, _matrix(asked), k)
        search.add(there.column("vec_id").to_numpy(), _matrix(there))
        return pa.Table.from_batches([search.rows()])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_row, query_id, rank, vec_id and score (distance) of the ``k`` nearest vectors of every query.

    Both tables have vec_id and embedding.
    """
    spark = vectors.sparkSession
    ship(spark)
    # Numbered once and written, so that a lost executor's rows come back with the same numbers.
    there = durable(usable(vectors).withColumn("n", F.monotonically_increasing_id()))
    asked = durable(usable(queries).distinct().withColumn("query_row", F.monotonically_increasing_id()))
    size = F.size("vector").alias("size")
    measured = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    (n_there, v_there), (_, v_asked) = measured(there), measured(asked)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-v_asked // BLOCK_VALUES))
    tiles = max(1, -(-v_there // TILE_VALUES), min(-(-wanted // blocks), -(-n_there // LEAST_CANDIDATES)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    place = lambda c, n, name: F.pmod(c, F.lit(n)).cast("long").alias(name)
    key = ["size", "block", "tile"]
    left = asked.select("*", size, place("query_row", blocks, "block"), every(tiles, "tile"))
    right = there.select("vec_id", "vector", size, every(blocks, "block"), place("n", tiles, "tile"))
    cells = min(blocks * tiles, 100_000)
    left, right = (x.repartition(cells, *key).groupBy(*key) for x in (left, right))
    found = left.cogroup(right).applyInArrow(_cell(k), "query_row long, query_id long, vec_id long, score double")
    return _merged(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Tasks' heaps merged by query row; the rank filter prunes each task's rows before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
