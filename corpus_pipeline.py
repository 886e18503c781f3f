"""A corpus made ready for training: rules, classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again before the
next one. All stages but the last return the columns of ``documents``.

Defined results: rows are documents, whatever their ids. Null or blank texts fail the base rules; of rows
that share an id each is judged by its own text, and where their texts are not linked all stay; rows
without an id stay unless an equal or near text stays for them. Without labels only the base rules reject
and every document scores 0.5, which is kept. Empty documents give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import classifier, packing, quality_rules, simhash
from concordat.llm._common import remove, shared_folder, tables_removed


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or a certified cutoff go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half go; all labelled documents are learnt from, rejected ones too."""
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=whole)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest id stays, or one row where none has an id."""
    return simhash.keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Training and best-fit search are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder.

    A stage's input, and the tables that it wrote for itself, are removed once its output is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES:
            with tables_removed(spark):
                stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if last is not None:
                remove(spark, last)
            last = f"{folder}/{name}"
    except BaseException:
        remove(spark, folder)  # nothing of a run that failed stays behind
        raise
    return docs
