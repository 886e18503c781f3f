import gzip
import io
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from concordat.llm import warc as W

FIELDS = "record_id string, type string, target_uri string, date timestamp, status int, headers map<string,string>, payload_digest string, url string, outcome string"
DAY = datetime(2024, 3, 1)


def rec(name, kind, hours, headers=None, uri="http://www.Site.org/a/?b=2&a=1&utm_source=x#f", status=None, digest=None):
    at = None if hours is None else DAY + timedelta(hours=hours)
    return (name, kind, uri, at, status if status is not None else 200 if kind == "response" else 304, headers, digest or f"d-{name}", "clash", "clash")


def resolve(spark, rows):
    found = W.resolve_revisits(spark.createDataFrame(rows, FIELDS)).collect()
    return {r["record_id"]: r for r in found}


def test_as_of_join_and_validators(spark):
    rows = [
        rec("r1", "response", 0, {"ETag": '"1"', "Content-Type": "t", "Date": "old", "X": "kept"}),
        rec("r2", "response", 200, {"etag": '"2"', "Last-Modified": "m"}, uri="https://site.org:443/a?a=1&b=2"),
        rec("r2b", "response", 200, {"etag": '"2"', "Last-Modified": "m"}),
        rec("bad", "response", 201, {"etag": '"9"'}, status=500),
        rec("v0", "revisit", -1, {"etag": '"1"'}), rec("v1", "revisit", 1, {"Etag": 'W/"1"', "Date": "new", "X": "not permitted", "content-type": "no"}),
        rec("v2", "revisit", 150, {"etag": '"1"'}), rec("v3", "revisit", 200, {"etag": '"1"'}), rec("v4", "revisit", 260, {"last-modified": "m"}),
        rec("v5", "revisit", 300, {"etag": '"7"', "last-modified": "m"}), rec("v6", "revisit", 300, None), rec("v7", "revisit", None, {"etag": '"1"'}),
        rec("v8", "revisit", 10, {"etag": '"1"'}, uri=None), rec("v9", "revisit", 10, {"etag": '"1"'}, uri="http://other.org/"), rec("w", "warcinfo", 5),
    ]
    found = resolve(spark, rows)
    got = {k: (r["outcome"], r["response_id"]) for k, r in found.items()}
    assert got == {
        "v0": ("no_response", None), "v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("resolved", "r1"), "v4": ("resolved", "r2b"),
        "v5": ("changed", "r2b"), "v6": ("unvalidated", "r2b"), "v7": ("no_response", None), "v8": ("no_response", None), "v9": ("no_response", None),
    }
    assert found["v1"]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "new", "x": "kept"} and found["v1"]["payload_digest"] == "d-r1"
    assert found["v5"]["headers"] is None and found["v5"]["payload_digest"] is None


def test_hot_url_matches_brute_force(spark):
    rows = [rec(f"r{i:03}", "response", (i * 37) % 900, {"etag": '"e"'}) for i in range(200)] + [rec(f"v{i:03}", "revisit", (i * 53) % 950, {"etag": '"e"'}) for i in range(200)]
    found = resolve(spark, rows + [rows[-1]])
    for name, kind, _, at, *_ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0]) for r in rows if r[1] == "response" and r[3] < at]
            assert found[name]["response_id"] == (max(earlier)[1] if earlier else None)


def test_empty_table(spark):
    assert W.resolve_revisits(spark.createDataFrame([], FIELDS)).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>é</p>"), (2, None, None)], "page_id long, url string, html string")
    records = W.captures_of_pages(pages).select("record_id", "type", "target_uri", "date", "status", "headers", F.lit(b"body\r\n\r\nmore").alias("payload"), "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    for i, row in enumerate(W.warc_files(records.coalesce(1)).collect()):
        (tmp_path / f"{i}.warc.gz").write_bytes(row["content"])
    back = {r["record_id"]: r for r in W.read_warc(spark, f"{tmp_path}/*.warc.gz").collect()}
    for r in records.collect():
        b = back[r["record_id"]]
        assert (b["type"], b["target_uri"], b["date"], b["status"], b["payload"], b["payload_digest"]) == (r["type"], r["target_uri"], r["date"], r["status"], r["payload"], r["payload_digest"])
        assert b["headers"] == {k.lower(): v for k, v in r["headers"].items() if v is not None} or None in r["headers"].values()
    assert all(b["error"] is None for b in back.values())


def plain(*bodies, length=None):
    return b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %s\r\n\r\n%s\r\n\r\n" % (i, length or str(len(x)).encode(), x) for i, x in enumerate(bodies))


def read(content):
    return [(r["record_id"], r["payload"], (r["error"] or "")[:12]) for r in W.parse_warc(content)]


def test_what_cannot_be_read_is_a_row(monkeypatch):
    good = plain(b"one", b"WARC/1.0 inside", b"")
    want = [("urn:0", b"one", ""), ("urn:1", b"WARC/1.0 inside", ""), ("urn:2", b"", "")]
    packed = [gzip.compress(plain(b"one")), gzip.compress(plain(b"two" * 5000))]
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(W, "STEP", step)
        assert read(good) == want == read(gzip.compress(good)) and read(b"") == []
        assert [r[1:] for r in read(b"".join(packed))] == [(b"one", ""), (b"two" * 5000, "")]
        cut = read(packed[0] + packed[1][:-20])
        assert cut[0] == ("urn:0", b"one", "") and cut[1][1] is None and cut[1][2] == "EOFError: th" and len(cut) == 2
        broken = bytearray(packed[1])
        broken[30:40] = bytes(10)
        assert [r[2][:5] for r in read(packed[0] + bytes(broken))] in (["", "error"], ["", "zlib."], ["", "EOFEr"])
    assert read(plain(b"abc", length=b"many") + plain(b"next")) == [("urn:0", None, "Content-Leng"), ("urn:0", b"next", "")]
    assert read(plain(b"abc", length=b"-5"))[0][2] == "Content-Leng"
    assert read(good + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")[3:] == [(None, None, "the record i")]
    assert read(good + b"WARC/1.0\r\nContent-Le")[3:] == [(None, None, "a record's h")]
    assert read(b"no archive at all")[0][2] == "what follows"
    monkeypatch.setattr(W, "MAX_RECORD", 10)
    assert read(plain(b"x" * 50, b"y")) == [("urn:0", None, "the record h"), ("urn:1", b"y", "")]


def test_records_after_a_damaged_member_are_read(monkeypatch):
    rnd = random.Random(3)
    bodies = ["".join(rnd.choice("abcdef ") for _ in range(6000)).encode() for _ in range(4)]
    packed = [gzip.compress(plain(b)) for b in bodies]
    for step in (5, 100, 1 << 20):
        monkeypatch.setattr(W, "STEP", step)
        wrong_sum = bytearray(packed[1])
        wrong_sum[-6] ^= 1
        got = read(b"".join([packed[0], bytes(wrong_sum), packed[2], packed[3]]))
        assert [r[1] for r in got] == bodies  # its own record came whole
        assert [bool(r[2]) for r in got] == [False, True, False, False]
        torn = packed[1][:900]  # the next member begins inside of it
        got = read(b"".join([packed[0], torn, packed[2], packed[3]]))
        assert [r[1] for r in got[:1] + got[2:]] == [bodies[0], bodies[2], bodies[3]] and [bool(r[2]) for r in got] == [False, True, False, False]
        headless = b"\x1f\x8b\x09" + packed[1][3:]
        assert [r[1] for r in read(b"".join([packed[0], headless, packed[2]]))] == [bodies[0], None, bodies[2]]
        assert [r[1] for r in read(b"".join([packed[0], b"junk between" * 40, packed[2]]))] == [bodies[0], None, bodies[2]]
    two = gzip.compress(plain(b"first", bodies[0][:3000], b"last" * 100))
    hurt = bytearray(two)
    hurt[len(two) // 2] ^= 255
    got = read(bytes(hurt) + packed[3])
    assert got[0][1] == b"first" and got[-1][1] == bodies[3] and any(r[2] for r in got)


def test_names_in_member_heads_and_padding():
    named = io.BytesIO()
    with gzip.GzipFile("some name", "wb", fileobj=named) as f:
        f.write(plain(b"x"))
    extra = bytearray(gzip.compress(plain(b"y")))
    extra[3] |= 4 | 16
    extra[10:10] = b"\x03\x00abc" + b"a comment\0"
    got = read(named.getvalue() + bytes(12) + bytes(extra) + gzip.compress(b"") + gzip.compress(plain(b"z")))
    assert [r[1:] for r in got] == [(b"x", ""), (b"y", ""), (b"z", "")]


def test_lengths_of_any_number_of_digits():
    for digits in (19, 5000, 100_000):
        got = read(plain(b"abc", length=b"9" * digits) + plain(b"next"))
        assert [(r[1], bool(r[2])) for r in got] == [(None, True), (b"next", False)]
    assert read(plain(b"abc", length=b"0" * 5000 + b"3")) == [("urn:0", b"abc", "")]


def test_files_of_all_kinds_in_one_job(spark, tmp_path):
    files = {"a.warc.gz": gzip.compress(plain(b"one"))[:-15], "b.warc": plain(b"x", length=b"?"), "c.warc": plain(b"fine"), "d.warc": b""}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = W.read_warc(spark, f"{tmp_path}/*.warc*").collect()
    assert sorted((r["error"] or "")[:4] for r in rows) == ["", "Cont", "EOFE"]


def test_default_ports_and_parameters(spark):
    urls = ["http://a.org:80/x", "https://a.org:443/x", "http://www.a.org/x/", "http://a.org:443/x", "https://a.org:80/x", "http://a.org/x?ref=1", "http://a.org/x?ref=2&utm_medium=z"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", W.canonical_url(F.col("u")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == ["a.org/x"] * 3 + ["a.org:443/x", "a.org:80/x", "a.org/x?ref=1", "a.org/x?ref=2"]


def test_one_url_in_one_second_is_dealt_to_several_cells(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL_ROWS", 20)
    rows = [rec(f"r{i:03}", "response", 1, {"etag": '"e"'}) for i in range(90)] + [rec(f"v{i:03}", "revisit", 1 + i % 3, {"etag": '"e"'}) for i in range(90)]
    found = resolve(spark, rows)
    assert {k: r["response_id"] for k, r in found.items()} == {f"v{i:03}": "r089" if i % 3 else None for i in range(90)}
