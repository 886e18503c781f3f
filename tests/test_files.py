"""Files listed and read in ranges of pages by the executors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from concordat.engine import Engine
from concordat.sources import documents
from concordat.sources.files import FormFeeds, Paged, list_files, page_ranges, read_pages


def names(df):
    return sorted(r["name"] for r in df.collect())


@pytest.fixture
def tree(tmp_path):
    for p in ("a.txt", "b.md", "x/c.txt", "x/y/d.txt", "z/e.txt", "_hidden/f.txt", "x/.g.txt", "q 1%.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("one\ftwo")
    (tmp_path / "empty.txt").write_text("")
    return tmp_path


def test_list(spark, tree):
    assert names(list_files(spark, str(tree))) == ["a.txt", "b.md", "c.txt", "d.txt", "e.txt", "empty.txt", "q 1%.txt"]
    assert names(list_files(spark, f"{tree}/*.txt")) == ["a.txt", "empty.txt", "q 1%.txt"]
    assert names(list_files(spark, f"file://{tree}/{{a,b}}.*")) == ["a.txt", "b.md"]
    assert names(list_files(spark, f"{tree}/[!a-x]/*.txt")) == ["e.txt"]
    assert names(list_files(spark, f"{tree}/x")) == ["c.txt", "d.txt"]
    assert names(list_files(spark, f"{tree}/a.txt")) == ["a.txt"]
    assert names(list_files(spark, f"{tree}/none")) == names(list_files(spark, f"{tree}/none/*.txt")) == []
    sizes = {r["name"]: r["size"] for r in list_files(spark, str(tree)).collect()}
    assert sizes["empty.txt"] == 0 and sizes["a.txt"] == 7


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    texts = [f"page {i} é\U0001f600 " + "x" * (i % 97) for i in range(1000)]
    texts[3] = texts[4] = ""
    texts[500] = "long " * 5000
    content = "\f".join(texts).encode()
    (tmp_path / "big.txt").write_bytes(content)
    parser = FormFeeds(range_bytes=1000)
    ranges = page_ranges(list_files(spark, str(tmp_path)), parser)
    assert ranges.count() > 30
    pages = read_pages(ranges, parser).withColumn("task", F.spark_partition_id())
    assert pages.select("task").distinct().count() > 1
    rows = pages.orderBy("page_number").collect()
    assert [r["text"] for r in rows] == texts and [r["page_number"] for r in rows] == list(range(1, 1001))
    assert {r["document_id"] for r in rows} == {hashlib.sha256(content).hexdigest()[:16]}


@pytest.mark.parametrize("text", ["\f", "a\f", "\fa", "\f\f\f", "a", "﻿a\fb", "\f".join("abcdefgh")])
@pytest.mark.parametrize("size", [0, 1, 3])
def test_ranges_put_together_are_the_pages(text, size, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes(text.encode())
    parser, found = FormFeeds(range_bytes=size), []
    with open(path, "rb") as f:
        cuts = parser.ranges(f)[1]
    for first, n, start, stop in cuts:
        assert first == len(found) + 1
        with open(path, "rb") as f:
            part = parser.read(f, first, n, start, stop)
        assert len(part) == n
        found += part
    assert found == text.split("\f")


def test_same_as_whole_files(spark, tree):
    (tree / "bad.txt").write_bytes(b"fine\f\xff\xfe")
    (tree / "cut.txt").write_bytes("xé".encode()[:-1])
    key = ["document_id", "document_name", "page_number", "text", "char_count", "has_text"]
    whole = documents.parse(documents.read_documents(spark, f"{tree}/*.txt"))
    ranged = documents.parse_files(spark, f"{tree}/*.txt")
    got, want = (sorted(map(repr, df.select(*key, F.substring_index("error", ":", 1)).collect())) for df in (ranged, whole))
    assert got == want and len(got) == 7


def test_format_of_single_pages(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(1, 121)))
    (tmp_path / "bad.bin").write_bytes(b"\x00")
    (tmp_path / "late.bin").write_bytes(bytes([9] * 60 + [0]))

    def count(content):
        if content[0] == 0:
            raise ValueError("not this format")
        return len(content)

    def pages(content, first, n):
        part = content[first - 1 : first - 1 + n]
        if 0 in part:
            raise ValueError("a damaged page")
        return [str(b) for b in part]

    rows = Engine(spark, parser=Paged(count, pages, pages_a_range=50), kinds=(".bin",)).parse(str(tmp_path)).collect()
    of = lambda name: sorted((r for r in rows if r["document_name"] == name), key=lambda r: r["page_number"] or 0)
    assert [r["text"] for r in of("a.bin")] == [str(i) for i in range(1, 121)]
    assert [r["error"] for r in of("bad.bin")] == ["ValueError: not this format"]
    late = of("late.bin")  # pages of other ranges are kept beside the error
    assert late[0]["error"] == "ValueError: a damaged page" and len(late) == 51
    assert of("bad.bin")[0]["document_id"] == hashlib.sha256(b"\x00").hexdigest()[:16]
