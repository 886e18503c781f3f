"""Documents from files: bytes to pages.

Text files are paged at form feeds, and read in ranges of pages (``files``). PDF needs a parser; the library
brings none. One that reads single pages is given as ``files.Paged``, and its files too are read in ranges;
one that is a function from bytes to page texts gets whole files from Spark's own binary source. That source
passes over files of no bytes; these are listed beside it, so that each is a document with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash
from ..operators.pages import newline_clean, with_metadata
from ..shipping import ship
from .files import FormFeeds, Paged, list_files, page_ranges, read_pages

Parser = Callable[[bytes], list[str]]


def split_form_feeds(content: bytes) -> list[str]:
    """The pages of a plain text file; raises ValueError if it is empty or not UTF-8."""
    if not content:
        raise ValueError("the document is empty")
    return content.decode("utf-8").split("\f")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, document_name, path and content of the files at ``path``; equal bytes have equal ids."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    empty = list_files(spark, path).filter("size = 0").select("path", F.lit("").cast("binary").alias("content"))
    files = files.unionByName(empty)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(short_hash(F.col("content")).alias("document_id"), name.alias("document_name"), "path", "content")


def parse(documents: DataFrame, parser: Parser = split_form_feeds) -> DataFrame:
    """Pages of documents: document_id, document_name, page_number (from 1), text, char_count, has_text, error.

    A document that cannot be parsed, or has no pages, gives one row with its error and no page number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    pages = parser(bytes(r.content))
                    if not pages:
                        raise ValueError("the document has no pages")
                    rows += [(r.document_id, r.document_name, i + 1, t, None) for i, t in enumerate(pages)]
                except Exception as e:  # noqa: BLE001  a parser may raise anything; it is reported with the document
                    rows.append((r.document_id, r.document_name, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["document_id", "document_name", "page_number", "text", "error"])
            yield out.astype({"page_number": "Int32"})

    ship(documents.sparkSession)
    raw = documents.select("document_id", "document_name", "content")
    pages = raw.mapInPandas(run, "document_id string, document_name string, page_number int, text string, error string")
    return with_metadata(pages.withColumn("text", newline_clean(F.col("text"))))


def parse_files(spark: SparkSession, path: str, parser: Parser | FormFeeds | Paged = split_form_feeds, files: DataFrame | None = None) -> DataFrame:
    """Pages of the files at ``path``, as ``parse`` gives them; ``files`` is their list, if it was made before."""
    if parser is split_form_feeds:
        parser = FormFeeds()
    if not isinstance(parser, (FormFeeds, Paged)):
        return parse(read_documents(spark, path), parser)
    pages = read_pages(page_ranges(list_files(spark, path) if files is None else files, parser), parser)
    return with_metadata(pages.withColumn("text", newline_clean(F.col("text"))))


def read_cases(spark: SparkSession, path: str, field: str = "cases") -> DataFrame:
    """The rows of a nested JSON file of benchmark cases."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode(field).alias("c")).select("c.*") if field in raw.columns else raw


def sample_pages(pages: DataFrame, batches: list[tuple[int, str, int]]) -> DataFrame:
    """A fixed sample of pages: (batch, document_id, page_number), given as literals."""
    rows = F.array(*(F.struct(F.lit(b).alias("batch_id"), F.lit(d).alias("document_id"), F.lit(p).alias("page_number")) for b, d, p in batches))
    wanted = pages.sparkSession.range(1).select(F.explode(rows).alias("w")).select("w.*")
    return pages.join(F.broadcast(wanted), ["document_id", "page_number"])  # as many rows as literals


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
