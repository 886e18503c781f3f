"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, bpe_fragments, chat, classifier, filter_audit, licenses, packing, quality_rules, simhash, url_filter, warc, whitening
from ._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.apply_quality_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trees = chat.as_threads(turns.unionByName(chat.forged_conversation(spark)))
    return chat.digests(chat.format_trees(trees, distinct_nodes=True))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


#: Entries of the URL query: action, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.captures_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.resolve_revisits(records)
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    time = lambda c, name: F.unix_seconds(c).alias(name)
    return found.select("record_id", "url", time("date", "revisit_time"), "outcome", "response_id", time("response_date", "response_time"), "payload_digest", F.array_join(lines, "\n").alias("headers"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_licenses(spark))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_bpe_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query and op7 need the vocabulary files

    return bpe_fragments.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_rules,
        op2_chat_formatting,
        op3_best_fit_packing,
        op4_url_filter,
        op5_warc_revisits,
        op6_quality_classifier,
        op7_byte_bpe,
        op8_nearest_neighbours,
        op9_simhash,
        op10_license_scan,
        op11_embedding_whitening,
        op12_filter_audit,
        op13_bpe_fragments,
    )
    return {f.__name__: f for f in own}
