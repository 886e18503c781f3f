"""Intermediate results that outlive an executor, and joins on keys of which some are frequent."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many frequent keys are set apart (and broadcast) in a join; how frequent these are follows from it.
MOST_HOT_KEYS = 50_000
#: A key with fewer rows is never set apart.
LEAST_HOT_ROWS = 256


def sound(spark: SparkSession) -> None:
    """Unions are planned as of no partitioning.

    Spark 4.1 takes a union of equally partitioned sides as partitioned alike. Where a join in one side then
    becomes a broadcast join at run time, that side is not, and a join or aggregate above the union on the
    same keys, which has no shuffle of its own, meets only a part of a key's rows: its result is wrong.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder, on one machine only (tests)."""
    sound(spark)
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="concordat-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder.

    The lineage is cut, so a lost executor costs a re-read and not a recomputation. Spark removes the files with
    the session's reference if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: The open scopes of a thread, each with the tables written inside.
_scopes = threading.local()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later reads take only the columns they need.

    It is removed at the end of the innermost ``tables_removed`` of this thread; outside of any it stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if open_ := getattr(_scopes, "open", None):
        open_[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside have no generated method of over 8,000 bytes, which the JVM would only interpret.

    A projection of many patterns is one such method; with this limit its expressions are compiled in parts.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are removed at the end, when their readers have been written too."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            remove(spark, path)


def join_frequent(rows: DataFrame, named: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``named`` (one row for a key), with no task that takes all rows of a frequent key.

    ``counts`` has the key and ``n``, its number of rows, of which there are ``total`` at most. At most
    ``MOST_HOT_KEYS`` keys can have over ``total / MOST_HOT_KEYS`` rows; those are broadcast and joined where the
    rows are, all others by a shuffle. ``how``: inner, or left, which keeps rows with a null key.
    """
    least = max(LEAST_HOT_ROWS, -(-total // MOST_HOT_KEYS))
    if total <= least:  # no key can be frequent
        return rows.join(named, key, how)
    hot = F.broadcast(counts.filter(F.col("n") > least).select(key))
    frequent = F.broadcast(named.join(hot, key, "left_semi"))
    rare = rows.join(hot, key, "left_anti")
    often = rows.join(hot, key, "left_semi")
    return rare.join(named, key, how).unionByName(often.join(frequent, key, how))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores dealt to all of them before work on each row.

    A small file is one row group, which one task reads; large tables have partitions enough and stay as they are.
    """
    sound(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
