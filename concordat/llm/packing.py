"""Conflict-constrained best-fit packing of documents into training sequences.

A document's length is its number of words. Every full ``capacity`` of a longer document is a sequence
of its own; what is left (and every shorter document, an empty one too) is packed with others. Two
pieces conflict if they have the same source or belong to the same duplicate cluster (texts equal but
for letter case and white space), and never share a bin.

Equal rows are counted, not carried: only ids, lengths, hashes and counts are shuffled, never texts.
They are dealt by hash into shards of about ``SHARD_ROWS`` pieces, at most ``MOST_COPIES`` equal ones
together, so a shard is bounded whatever the ids, sources or clusters. Within a shard pieces go largest
first. Bins are kept ordered by residual and carry a bitmap of sources and one of clusters; from the
smallest sufficient residual the search goes on to the next bins until the first, and so tightest,
without a conflict is found; if there is none a bin is opened. Bins that a shard leaves emptier than
``FULL_ENOUGH`` are taken apart, and their pieces packed again together with those of all other shards.

Defined results: null sources conflict with none; a null text has no words; rows that repeat an id, or
are equal in everything, are separate documents (and conflict by cluster), so bin ids number equal rows;
ties in length go by id, cluster, source and that number; the result is the same however the input is
partitioned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import WS_CHARS, WS_RUN, durable, word_count

CAPACITY = 2_048
SHARD_ROWS = 4_096
#: So many equal rows stay together at most.
MOST_COPIES = 512
#: Share of the capacity from which a bin stays as the first round packed it.
FULL_ENOUGH = 0.9
SCHEMA = "bin_id string, doc_id long, piece long, start long, n_words long, position int"
_PACKED = "bin_id string, no_id boolean, doc_id long, source string, cluster long, copy long, piece long, start long, n_words long, position int, fill long"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster) in the given order; negative sources or clusters are free of conflicts."""
    order: list[tuple[int, int]] = []  # (residual, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        src = 1 << source if source >= 0 else 0
        dup = 1 << cluster if cluster >= 0 else 0
        at, n = bisect_left(order, (size, -1)), len(order)
        while at < n and (sources[order[at][1]] & src or clusters[order[at][1]] & dup):
            at += 1
        if at < n:
            residual, b = order.pop(at)
            sources[b] |= src
            clusters[b] |= dup
        else:
            residual, b = capacity, len(sources)
            sources.append(src)
            clusters.append(dup)
        insort(order, (residual - size, b))
        out.append(b)
    return out


def _codes(values: pd.Series) -> list[int]:
    """Small numbers for values that occur twice or more; -1 for those that cannot conflict."""
    counts = values.value_counts()
    known = {v: i for i, v in enumerate(counts.index[counts > 1])}
    return [known.get(v, -1) for v in values]


def _pack_shard(capacity: int, name: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.loc[rows.index.repeat(rows["n_copies"])].reset_index(drop=True)
        rows["copy"] = rows["copy"] + rows.groupby(["no_id", "doc_id", "source", "cluster", "copy"], dropna=False).cumcount()
        rows = rows.sort_values(["n_words", "no_id", "doc_id", "cluster", "source", "copy"], ascending=[False, False, True, True, True, True], kind="stable", na_position="first")
        rows = rows.reset_index(drop=True)
        bins = best_fit(list(zip(rows["n_words"].tolist(), _codes(rows["source"]), _codes(rows["cluster"]))), capacity)
        rows["bin_id"] = [f"{name}-{key[0]}-{b}" for b in bins]
        by_bin = rows.groupby("bin_id")
        rows["position"] = by_bin.cumcount().astype("int32")
        rows["fill"] = by_bin["n_words"].transform("sum")
        return rows[[f.split()[0] for f in _PACKED.split(", ")]]

    return run


def _round(pieces: DataFrame, n: int, capacity: int, shard_rows: int, name: str) -> DataFrame:
    shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy", F.lit(name)), F.lit(shards)).alias("shard")
    return pieces.select(shard, "no_id", "doc_id", "source", "cluster", "copy", "n_copies", "piece", "start", "n_words").groupBy("shard").applyInPandas(_pack_shard(capacity, name), _PACKED)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """bin_id, doc_id, piece, start and n_words (in words) and position of every piece of every document."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.xxhash64(F.regexp_replace(F.lower(F.trim(text, F.lit(WS_CHARS))), WS_RUN, " "))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), same.alias("cluster"), word_count(text).alias("n"))
    sized = durable(sized.groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("n_rows")))
    # Equal rows in runs of MOST_COPIES: the first one's number, and how many there are.
    runs = F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(MOST_COPIES).cast("long"))
    runs = sized.select("*", F.explode(runs).alias("copy")).withColumn("n_copies", F.least(F.lit(MOST_COPIES), F.col("n_rows") - F.col("copy")))
    whole = F.floor(F.col("n") / capacity)  # sequences that the document fills alone
    each = runs.filter(whole > 0).select("*", F.explode(F.sequence(F.col("copy"), F.col("copy") + F.col("n_copies") - 1)).alias("number"))
    told = lambda c: F.coalesce(c, F.lit("null"))
    full = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece")).select(
        F.concat_ws("-", F.lit("full"), told(F.col("doc_id").cast("string")), F.hex("cluster"), told(F.md5(F.col("source").cast("binary"))), "number", "piece").alias("bin_id"),
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("n_words"),
        F.lit(0).alias("position"),
    )
    # A null among ids would turn all of a shard's into floats, so that it goes as a flag.
    columns = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "source", "cluster", "copy", "n_copies"]
    rest = runs.filter((F.col("n") % capacity > 0) | (F.col("n") == 0)).select(*columns, whole.alias("piece"), (whole * capacity).alias("start"), (F.col("n") % capacity).alias("n_words"))
    n = rest.agg(F.sum("n_copies")).first()[0] or 0
    packed = _round(rest, n, capacity, shard_rows, "a")
    if n > shard_rows:
        packed = durable(packed)
        loose = packed.filter(F.col("fill") < FULL_ENOUGH * capacity).withColumn("n_copies", F.lit(1).cast("long"))
        packed = packed.filter(F.col("fill") >= FULL_ENOUGH * capacity).unionByName(_round(loose, loose.count(), capacity, shard_rows, "b"))
    own = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return packed.select("bin_id", own, "piece", "start", "n_words", "position").unionByName(full)
