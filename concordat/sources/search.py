"""Search for a text inside of texts by an inverted index of trigrams.

Each text is filed under every three characters that follow one another in it, in lower case. A query's
rarest trigrams give the texts that can hold it, by intersecting their posting lists; these few are
verified against the text itself. Postings lie in folders by a hash of the trigram and are sorted in
them, so that a query reads the folders of its own trigrams only. A query of under three characters has
no trigram and is answered by reading all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of an index.
BUCKETS = 256
#: So many of a query's trigrams are looked up; more would hardly prune.
ASKED = 4
#: Keys a text is known by.
POSTING = ("bucket", "gram")


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """bucket, gram and ``keys`` for every trigram of every text."""
    rows = texts.select(*keys, F.explode(grams(F.coalesce(text, F.lit("")))).alias("gram"))
    return rows.select(_bucket(F.col("gram")).alias("bucket"), "gram", *keys)


def write_index(texts: DataFrame, keys: list[str], text: str, path: str) -> None:
    # Frequent trigrams are dealt by the text's key as well, so that no task gets a whole posting list.
    filed = postings(texts, keys, text).repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(16)))
    filed.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)


def asked_grams(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[k : k + 3] for k in range(len(q) - 2)})


def candidates(index: DataFrame, query: str, keys: list[str]) -> DataFrame | None:
    """The keys of texts that hold the query's rarest trigrams; None if the query has none."""
    asked = asked_grams(query)
    if not asked:
        return None
    spark = index.sparkSession
    hashed = spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
    bucket = {r["gram"]: r["bucket"] for r in hashed.collect()}  # as many as the query has characters
    of = lambda some: index.filter(F.col("bucket").isin(sorted({bucket[g] for g in some})) & F.col("gram").isin(some))
    counts = {r["gram"]: r["n"] for r in of(asked).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    if len(counts) < len(asked):
        return index.select(*keys).limit(0)  # a trigram that no text has
    rarest = sorted(asked, key=lambda g: (counts[g], g))[:ASKED]
    held = of(rarest).groupBy(*keys).agg(F.count_distinct("gram").alias("n"))
    return held.filter(F.col("n") == len(rarest)).select(*keys)


def search(texts: DataFrame, index: DataFrame, query: str, keys: list[str], text: Column) -> DataFrame:
    """The rows of ``texts`` whose ``text`` holds the query, without regard to case."""
    found = candidates(index, query, keys)
    able = texts if found is None else texts.join(found, keys, "left_semi")
    return able.filter(F.contains(F.lower(text), F.lit(query.lower())))
