"""SimHash near-duplicates by a generalised pigeonhole search.

1. *Fingerprint* (Arrow batches): A-Z are lower-cased, words are runs of anything but ASCII white
   space, each three-word shingle is hashed by XXH64 with seed 42, and a bit of the fingerprint is set
   if it is set in over half of the hashes.
2. *Distinct fingerprints*: equal ones collapse to one node (its smallest doc_id) before any search,
   so a group of exact copies costs as much as one text.
3. *Partitions*: bits that are correlated over all nodes are put into the same of four parts. With
   thresholds t_i and sum(t_i + 1) = limit + 1, two fingerprints within the limit differ by at most
   t_i bits in some part i. For each node, dynamic programming over the parts' value counts picks the
   thresholds with the fewest expected candidates: a part whose value is frequent gets -1 (not probed)
   and a rare one a higher threshold.
4. *Probe and verify*: each node is filed under its own value of every part and under the values it
   probes. Nodes under one key are verified against one another; a task emits for every group of
   linked nodes only the edges to one of them, so its output is linear. A key with more than
   ``SPLIT_ROWS`` nodes is filed again by four parts of the remaining bits, which is exact as well:
   two linked nodes under the key agree in at least one of these. This is repeated until no key is
   as full (or no bits are left to part), so that what a task holds is bounded.
5. *Components*: alternating large-star and small-star rounds on the edges, each written to the
   checkpoint folder, until nothing changes. Hubs are joined apart from all other nodes, so that no
   task takes all edges of one. Rounds grow with the logarithm of a component's size; should they
   not settle, an error is raised and no partial result returned.

Defined results: a null or blank text has fingerprint zero and is linked like any other; a text of
fewer than three words is one shingle; rows with equal ids each get a result; a row with a null doc_id
takes the component of an equal fingerprint that has an id, else null, and links nothing; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import MOST_HOT_KEYS
from ..shipping import ship
from ._common import durable, join_frequent

BITS, PARTS, LIMIT, SEED, SHINGLE = 64, 4, 3, 42, 3
WIDTH = BITS // PARTS
#: Most units (threshold + 1) that one part is given; 2 means all values at one bit's distance.
MOST_UNITS = 2
#: Keys with more rows than this are filed again by parts of the remaining bits.
SPLIT_ROWS = 20_000
#: Groups up to this size are compared by shifted copies of the sorted rows, larger ones by search.
SMALL_GROUP = 48
#: What a filed row costs, counted in candidate comparisons.
ROW_COST = 16


# -- fingerprints -----------------------------------------------------------------------------------


def fingerprint(text: str | None, step: int = 1 << 16) -> int:
    """The fingerprint of one text, as an unsigned integer; memory is bounded by ``step`` shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - SHINGLE + 1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    last = ends[min(SHINGLE, len(tokens)) - 1 :].tolist()
    first = (ends - sizes + 1)[:n].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + step], last[at : at + step])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the ``carried`` long columns of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


# -- partitions and thresholds ----------------------------------------------------------------------


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 1 << 15):
            bits = np.unpackbits(fps[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((i * BITS + j).astype(np.int32)), pa.array(total[i, j])], ["cell", "n"])


def choose_parts(together: np.ndarray, n: int) -> list[list[int]]:
    """Bits by part: each part starts with the most correlated free pair and takes what correlates best with it."""
    p = np.diag(together) / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for _ in range(PARTS):
        order = sorted(free)
        own = [order[int(np.argmax(corr[np.ix_(order, order)].sum(axis=1)))]]
        free.discard(own[0])
        while len(own) < WIDTH:
            order = sorted(free)
            own.append(order[int(np.argmax(corr[np.ix_(order, own)].mean(axis=1)))])
            free.discard(own[-1])
        parts.append(sorted(own))
    return parts


def part_values(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The value of each part, as an array of shape (parts, rows)."""
    out = np.zeros((len(parts), len(fps)), np.int64)
    for k, bits in enumerate(parts):
        for at, bit in enumerate(bits):
            out[k] |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << at
    return out


def thresholds(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Units (threshold + 1, summing to LIMIT + 1) by part and row: fewest candidates and filed rows."""
    n = values.shape[1]
    cost = np.zeros((PARTS, MOST_UNITS + 1, n))
    for k in range(PARTS):
        cost[k, 1] = counts[k][values[k]]
        ring = sum(counts[k][values[k] ^ (1 << bit)] for bit in range(WIDTH))
        cost[k, 2] = cost[k, 1] + ring + WIDTH * ROW_COST
    best = np.full((PARTS + 1, LIMIT + 2, n), np.inf)
    pick = np.zeros((PARTS + 1, LIMIT + 2, n), np.int8)
    best[0, 0] = 0
    for k in range(PARTS):
        for total in range(LIMIT + 2):
            for units in range(min(MOST_UNITS, total) + 1):
                c = best[k, total - units] + cost[k, units]
                better = c < best[k + 1, total]
                best[k + 1, total] = np.where(better, c, best[k + 1, total])
                pick[k + 1, total] = np.where(better, units, pick[k + 1, total])
    left, units = np.full(n, LIMIT + 1), np.zeros((PARTS, n), np.int8)
    for k in range(PARTS - 1, -1, -1):
        units[k] = pick[k + 1, left, np.arange(n)]
        left = left - units[k]
    return units


def _file(parts: list[list[int]], counts) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 13):
                b = whole.slice(at, 1 << 13)
                fps, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                values = part_values(fps.view(np.uint64), parts)
                units = thresholds(values, counts.value)
                rows = np.arange(len(fps))
                keys, who, used = [], [], []
                for k in range(PARTS):
                    keys.append((k << WIDTH) | values[k])
                    who.append(rows)
                    before = sum(map(len, keys[:-1]))
                    probing = rows[units[k] == 2]
                    for bit in range(WIDTH):
                        keys.append((k << WIDTH) | (values[k][probing] ^ (1 << bit)))
                        who.append(probing)
                    mask = np.array([sum(1 << bit for bit in parts[k])], np.uint64).view(np.int64)[0]
                    used.append(np.full(sum(map(len, keys)) - before, mask))
                who, used = np.concatenate(who), np.concatenate(used)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(used), pa.array(fps[who]), pa.array(rep[who])], ["key", "used", "fp", "rep"]
                )

    return run


# -- verification -----------------------------------------------------------------------------------


def _search(fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked node to the first one reached, visiting each node once."""
    left, right, open_ = [], [], np.arange(len(fps))
    while len(open_) > 1:
        seed, open_ = open_[0], open_[1:]
        front = np.array([seed])
        while len(front) and len(open_):
            part, front = front[:64], front[64:]
            near = np.zeros(len(open_), bool)
            for i in part:
                near |= np.bitwise_count(fps[open_] ^ fps[i]) <= LIMIT
            found, open_ = open_[near], open_[~near]
            left.append(reps[found])
            right.append(np.full(len(found), reps[seed]))
            front = np.concatenate([front, found])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _edges_of(key: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by key: small groups by shifted comparison, large ones by search."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    small = np.repeat((sizes <= SMALL_GROUP) & (sizes > 1), sizes)
    at = np.flatnonzero(small)
    k, f, r = key[at], fps[at], reps[at]
    for shift in range(1, min(SMALL_GROUP, len(at))):
        same = k[shift:] == k[:-shift]
        if not same.any():
            break
        ok = same & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= LIMIT)
        left.append(r[shift:][ok])
        right.append(r[:-shift][ok])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        part = slice(starts[g], starts[g] + sizes[g])
        a, b = _search(fps[part], reps[part])
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; the last key of a batch waits for the rest of its rows."""

    def emit(rows):
        key, fps, reps = rows
        a, b = _edges_of(key, fps.view(np.uint64), reps)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([hi, lo], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held and rows[0][-1] == held[0][0][-1]:
            held.append(rows)
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, rows))
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if cut:
            yield emit(tuple(x[:cut] for x in rows))
        held = [tuple(x[cut:] for x in rows)]
    if held:
        yield emit(tuple(np.concatenate(x) for x in zip(*held)))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u > v, by smallest doc_id) that connect all nodes (fp, rep) within the limit."""
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    together = np.zeros(BITS * BITS, np.int64)
    for row in nodes.select("fp").mapInArrow(_bit_sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[row["cell"]] = row["n"]  # at most 64 x 64 rows
    parts = choose_parts(together.reshape(BITS, BITS), n)
    value = lambda bits: sum((F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long")), i) for i, b in enumerate(bits)), F.lit(0).cast("long"))
    counts = np.zeros((PARTS, 1 << WIDTH), np.float64)
    keys = F.array(*(value(bits) + F.lit(k << WIDTH) for k, bits in enumerate(parts)))
    found = nodes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).toArrow()  # at most 4 x 65,536 rows
    key = found["key"].to_numpy()
    counts[key >> WIDTH, key & ((1 << WIDTH) - 1)] = found["n"].to_numpy()
    del found, key
    filed = nodes.mapInArrow(_file(parts, spark.sparkContext.broadcast(counts)), "key long, used long, fp long, rep long")
    around = [counts[k] + sum(counts[k][np.arange(1 << WIDTH) ^ (1 << bit)] for bit in range(WIDTH)) for k in range(PARTS)]
    if np.max(around) > SPLIT_ROWS:  # some key may be too full: a value's nodes and all that could probe it
        filed = _split_full(filed)
    dealt = filed.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_verify, "u long, v long").distinct()


def _split_full(filed: DataFrame) -> DataFrame:
    """Filed rows of which no key has over ``SPLIT_ROWS`` rows, at any number of rows, if its bits can be parted.

    Full keys are broadcast if they are few; else they are joined by a shuffle.
    """
    done = None
    while True:
        filed = durable(filed)
        counts = filed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.bit_count("used")).alias("used"))
        full = counts.filter((F.col("n") > SPLIT_ROWS) & (F.col("used") <= BITS - PARTS)).select("key")
        full = F.broadcast(full) if full.count() <= MOST_HOT_KEYS else full
        again = filed.join(full, "key", "left_semi")
        rest = filed.join(full, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        if again.isEmpty():
            return done
        filed = again.mapInArrow(_file_again, "key long, used long, fp long, rep long")


def _file_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows under their values of four parts of the bits that their key does not use yet."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1 << 15):
            b = whole.slice(at, 1 << 15)
            key, used, fps, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for mask in np.unique(used):
                rows = np.flatnonzero(used == mask)
                free = [bit for bit in range(BITS) if not int(mask) >> bit & 1]
                for j, bits in enumerate(np.array_split(free, PARTS)):
                    value = part_values(fps[rows].view(np.uint64), [bits.tolist()])[0]
                    # The old key, the part and the value as one number; should two meet, rows are only compared needlessly.
                    old = key[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    mixed = (old ^ (old >> np.uint64(29))) + (value.view(np.uint64) * np.uint64(PARTS) + np.uint64(j)) * np.uint64(0xBF58476D1CE4E5B9)
                    now = np.uint64(sum(1 << int(bit) for bit in bits)) | np.array([mask], np.int64).view(np.uint64)[0]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mixed.view(np.int64)), pa.array(np.full(n, now, np.uint64).view(np.int64)), pa.array(fps[rows]), pa.array(rep[rows])], ["key", "used", "fp", "rep"]
                    )


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (u, v).

    Rounds go on until nothing changes, which takes about the logarithm of the longest chain; a caller that
    wants to bound them gets an error where they have not settled by then.
    """
    edges, seen = durable(edges.select("u", "v")), None
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Least neighbours are kept first, so that both sides of a join are dealt anew and a hub's rows can be split.
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(least.select("u", F.least("u", "m").alias("m")), "u")
        large = durable(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = durable(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document row."""
    own = durable(fingerprints(docs))
    nodes = durable(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    able = nodes.filter("rep IS NOT NULL").select("fp", "rep")
    found = components(links(able))
    named = able.join(found, able["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return join_frequent(own, named, "fp", nodes.select("fp", "n"), own.count(), "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of linked texts left, rows without an id included."""
    # Two hashes of 128 bits together stand for a row, so that texts are neither compared nor carried along.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*(c.isNull().cast("int").cast("string") for c in columns))  # xxhash64 passes over nulls
    marked = docs.withColumns({"__h0": F.xxhash64(nulls, *columns), "__h1": F.xxhash64(F.lit(1), nulls, *columns)})
    own = durable(fingerprints(marked, "__h0", "__h1"))
    # The fingerprint itself is the node's name: an id may stand for several texts, or for none.
    counts = durable(own.groupBy("fp").agg(F.count("*").alias("n")))
    found = components(links(counts.select("fp", F.col("fp").alias("rep")))).select(F.col("node").alias("fp"), "component")
    grouped = join_frequent(own, found, "fp", counts, own.count(), "left").withColumn("__group", F.coalesce("component", "fp"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "__h0", "__h1")
    first = grouped.groupBy("__group").agg(F.min(order).alias("m")).select(F.col("m.__h0").alias("__f0"), F.col("m.__h1").alias("__f1"))
    # Of rows that are equal in all columns each task passes on one, before texts are shuffled.
    different = marked.select("__h0", "__h1", F.struct(*columns).alias("__doc")).dropDuplicates(["__h0", "__h1"])
    return different.join(first, (F.col("__h0") == F.col("__f0")) & (F.col("__h1") == F.col("__f1")), "left_semi").select("__doc.*")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """Of ``keep_one_of_each`` the documents that have an id; rows without one are left out."""
    return keep_one_of_each(docs).filter("doc_id IS NOT NULL")
