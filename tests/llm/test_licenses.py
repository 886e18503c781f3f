import re
import textwrap

from concordat.llm import licenses as L

DOCS = "doc_id long, text string, digest string, ids string, license_id string"
MIT = L.TEXTS["MIT"]


def scan(spark, texts, known=None):
    df = spark.createDataFrame([(i, t, "c", "c", "c") for i, t in enumerate(texts)], DOCS)
    return [(r["whole_license"], r["notice_licenses"]) for r in L.scan(df, known if known is not None else L.known_licenses(spark)).orderBy("doc_id").collect()]


def test_whole_texts(spark):
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(MIT.upper().replace('"', "''"), 30))
    dressed = "Copyright (c) 2024 Somebody\n(C) 1999 others. All rights reserved.\n\n" + wrapped
    british = MIT.replace("sublicense", "sub-licence").replace("MIT License", "MIT Licence")
    texts = [MIT, dressed, british, MIT + " and more", L.TEXTS["0BSD"], L.TEXTS["ISC"], None, "", "© 2020 me"]
    assert [w for w, _ in scan(spark, texts)] == ["MIT", "MIT", "MIT", None, "0BSD", "ISC", None, None, None]


def test_notices_are_whole_lines(spark):
    texts = ["prose\nReleased under the MIT License.\nmore", "licensed under  CC-BY-NC 4.0\nLICENSED UNDER THE APACHE LICENCE, VERSION 2.0", "we released under the MIT License.", "x " * 50_000]
    assert [n for _, n in scan(spark, texts)] == ["MIT", "Apache-2.0,CC-BY-NC-4.0", None, None]


def test_all_stated_texts_are_found_however_they_are_set(spark):
    names = list(L.TEXTS)
    wrapped = ["/*\n" + "\n".join(f" * {y}" for x in L.TEXTS[n].split("\n") for y in (textwrap.wrap(x, 47) or [""])) + "\n */" for n in names]
    assert [w for w, _ in scan(spark, [L.TEXTS[n] for n in names] + wrapped)] == names * 2


def test_headers_are_paragraphs(spark):
    head = "\n".join("# " + x for x in textwrap.wrap(L.NOTICES["GPL-3.0-or-later"][0], 40))
    apache = "// Copyright 2020 me\n//\n// " + "\n// ".join(textwrap.wrap(L.NOTICES["Apache-2.0"][-1], 60)) + "\n//\n//     https://www.apache.org/licenses/LICENSE-2.0\n\nint main() {}"
    assert [n for _, n in scan(spark, [f"#!/bin/sh\n#\n{head}\n#\necho", apache, head.replace("program", "thing")])] == ["GPL-3.0-or-later", "Apache-2.0", None]


def test_many_lengths_of_known_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LENGTHS", 2)
    monkeypatch.setattr(L, "MAX_BROADCAST", 2)
    assert [n for _, n in scan(spark, ["prose\nReleased under the MIT License.\nmore", "x"])] == ["MIT", None]


def test_known_by_several_ids_repeats_and_empty_tables(spark):
    known = spark.createDataFrame([("B", "Do what you want."), ("A", "do what, YOU want"), (None, "x"), ("E", ""), ("E", None)], "license_id string, text string")
    assert scan(spark, ["Do what you want", "", None], known) == [("A,B", "A,B"), (None, None), (None, None)]
    assert scan(spark, ["x"], known.limit(0)) == [(None, None)]
    df = spark.createDataFrame([(1, "Do what you want", "", "", ""), (1, "other", "", "", ""), (None, "do what you want\n-", "", "", "")], DOCS)
    rows = L.scan(df, known).collect()
    found = sorted(((r["doc_id"], r["whole_license"], r["notice_licenses"]) for r in rows), key=repr)
    assert found == sorted([(1, "A,B", "A,B"), (1, None, None), (None, "A,B", "A,B")], key=repr)  # each row by itself
    assert L.scan(df.limit(0), known).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.range(3).selectExpr("id AS doc_id", "'Released under the MIT License.' AS text")
    plan = L.scan(df, L.known_licenses(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
