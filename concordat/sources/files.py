"""Files listed, and read in ranges of pages, by the executors.

What is known of a file only after it was opened, its pages and where they begin, cannot be planned by the
driver. So a first pass takes each file as a stream (its digest, its pages, the places to cut it at) and leaves
one row for a range of pages; a second pass deals these ranges to tasks of their own. Bytes are in no shuffle,
and the driver sees neither paths nor bytes. A file that cannot be read is one range with its error.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..shared import durable
from ..shipping import ship

#: A range of a text file is cut at the first page that begins after so many bytes.
RANGE_BYTES = 4 << 20
CHUNK = 1 << 20
#: Ranges that one task reads one after the other.
RANGES_A_TASK = 16
RANGES = "document_id string, document_name string, path string, first_page long, n_pages long, start long, stop long, error string"
PAGES = "document_id string, document_name string, page_number int, text string, error string"


@dataclass(frozen=True)
class FormFeeds:
    """Plain text in UTF-8, paged at form feeds; a range is read by its bytes, so that files may be of any size."""

    range_bytes: int = RANGE_BYTES

    def ranges(self, stream) -> tuple[str, list[tuple[int, int, int, int]]]:
        """Digest of the bytes, and (first page, pages, first byte, last byte + 1) of every range."""
        digest, decoder = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")()
        found, at, start, first, page = [], 0, 0, 1, 1
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
            decoder.decode(chunk)
            for feed in re.finditer(b"\f", chunk):
                page, after = page + 1, at + feed.end()
                if after - start > self.range_bytes:
                    found.append((first, page - first, start, after - 1))
                    first, start = page, after
            at += len(chunk)
        decoder.decode(b"", final=True)
        if not at:
            raise ValueError("the document is empty")
        return digest.hexdigest()[:16], [*found, (first, page + 1 - first, start, at)]

    def read(self, stream, first: int, n: int, start: int, stop: int) -> list[str]:
        stream.seek(start)
        return stream.read(stop - start).decode("utf-8").split("\f")


@dataclass(frozen=True)
class Paged:
    """A format of which single pages can be read from the whole bytes: ``count`` them, and ``pages(bytes, first, n)``.

    Each range reads the file's bytes, and only its own pages.
    """

    count: Callable[[bytes], int]
    pages: Callable[[bytes, int, int], list[str]]
    pages_a_range: int = 50

    def ranges(self, stream) -> tuple[str, list[tuple[int, int, int, int]]]:
        content = stream.read()
        if not content:
            raise ValueError("the document is empty")
        n, step = self.count(content), self.pages_a_range
        if not n:
            raise ValueError("the document has no pages")
        cuts = [(i + 1, min(step, n - i), 0, len(content)) for i in range(0, n, step)]
        return hashlib.sha256(content).hexdigest()[:16], cuts

    def read(self, stream, first: int, n: int, start: int, stop: int) -> list[str]:
        return list(self.pages(stream.read(), first, n))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    scheme, _, rest = uri.rpartition(":") if "://" not in uri else uri.partition(":")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest)}")


def _pattern(glob: str) -> str:
    """A file pattern (``*``, ``?``, ``[a-c]``, ``{x,y}``) as a regular expression; none of them passes a slash."""
    plain = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "," and depth:
            out += "|"
        else:
            depth += (c == "{") - (c == "}")
            out += plain.get(c) or re.escape(c)
        i += 1
    return out


def qualified(spark: SparkSession, path: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name and size of the files at ``path`` (a file, a folder with all below it, or a pattern of these).

    Files of no bytes are among them. Names that begin with ``_`` or ``.`` are passed over, folders included, as
    Spark does. The entries of the first folder are listed by one task, each folder among them by another; the
    list is computed once. With no files there are no rows.
    """
    ship(spark)
    parts = qualified(spark, path).rstrip("/").split("/")
    fixed = next((i for i, p in enumerate(parts) if re.search(r"[*?\[{]", p)), len(parts))
    base, globs = "/".join(parts[:fixed]), parts[fixed:]
    head = re.compile(_pattern(globs[0]) if globs else r".*", re.S)
    whole = re.compile("/".join(map(_pattern, globs)) + r"(?:/.*)?" if globs else r".*", re.S)

    def entries(root: str, recursive: bool) -> Iterator[tuple[str, str, int, bool]]:
        store, inside = opened(root)
        itself = store.get_file_info(inside)
        if itself.type == fs.FileType.File:
            yield root, itself.base_name, itself.size, False
            return
        for e in store.get_file_info(fs.FileSelector(inside, recursive=recursive, allow_not_found=True)):
            below = e.path[len(inside) :].lstrip("/")
            if not any(p.startswith(("_", ".")) for p in below.split("/")):
                yield f"{root.rstrip('/')}/{below}", e.base_name, e.size or 0, e.type == fs.FileType.Directory

    def listing(recursive: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for root in b["path"]:
                    rows = []
                    for p, name, size, folder in entries(root, recursive):
                        below = p[len(base) :].lstrip("/")
                        wanted = head.fullmatch(below) if not recursive else folder or whole.fullmatch(below)
                        if not below or (wanted and (folder or whole.fullmatch(below))):
                            rows.append((p, name, size, folder))
                    yield pd.DataFrame(rows, columns=["path", "name", "size", "folder"])

        return run

    schema = "path string, name string, size long, folder boolean"
    first = durable(spark.createDataFrame([(base,)], "path string").mapInPandas(listing(False), schema))
    deeper = first.filter("folder").repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(listing(True), schema)
    return durable(first.unionByName(deeper).filter("NOT folder").select("path", "name", "size"))


def page_ranges(files: DataFrame, parser: FormFeeds | Paged) -> DataFrame:
    """One row for each range of pages of the files (path, name), or for a file's error; computed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, name in zip(b["path"], b["name"]):
                try:
                    store, inside = opened(path)
                    with store.open_input_stream(inside) as stream:
                        ident, cuts = parser.ranges(stream)
                    rows = [(ident, name, path, *c, None) for c in cuts]
                except Exception as e:  # noqa: BLE001  a file or parser may raise anything; it is reported with the document
                    rows = [(_digest(path), name, path, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["document_id", "document_name", "path", "first_page", "n_pages", "start", "stop", "error"])
                yield out.astype({c: "Int64" for c in ("first_page", "n_pages", "start", "stop")})

    spark = files.sparkSession
    ship(spark)
    dealt = files.select("path", "name").repartition(4 * spark.sparkContext.defaultParallelism)
    return durable(dealt.mapInPandas(run, RANGES))


def _digest(path: str) -> str | None:
    """The digest of a file that has no pages; none if its bytes cannot be read either."""
    try:
        store, inside = opened(path)
        digest = hashlib.sha256()
        with store.open_input_stream(inside) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
        return digest.hexdigest()[:16]
    except OSError:
        return None


def read_pages(ranges: DataFrame, parser: FormFeeds | Paged) -> DataFrame:
    """document_id, document_name, page_number (from 1), text and error, from ``page_ranges``.

    A range that fails gives one row with its error and no page number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                if r.error is not None:
                    rows = [(r.document_id, r.document_name, None, None, r.error)]
                else:
                    first, n, start, stop = int(r.first_page), int(r.n_pages), int(r.start), int(r.stop)
                    try:
                        store, inside = opened(r.path)
                        with store.open_input_file(inside) as stream:
                            texts = parser.read(stream, first, n, start, stop)
                        if len(texts) != n:
                            raise ValueError(f"pages {first} to {first + n - 1} were expected, and {len(texts)} were read")
                        rows = [(r.document_id, r.document_name, first + i, t, None) for i, t in enumerate(texts)]
                    except Exception as e:  # noqa: BLE001  as above
                        rows = [(r.document_id, r.document_name, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["document_id", "document_name", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    spark = ranges.sparkSession
    ship(spark)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-ranges.count() // RANGES_A_TASK))
    return ranges.repartition(tasks, "path", "first_page").mapInPandas(run, PAGES)
