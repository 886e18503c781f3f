"""WARC records: reading, writing, and resolving not-modified revisits.

``resolve_revisits`` joins each revisit to the latest earlier full response of its canonical URL (an
as-of join), checks the validators, and merges into the response's headers those that a not-modified
answer may replace. Records are range-partitioned by URL, time and a row number into cells of about
``CELL_ROWS``, however often a URL was captured; a running window inside of a cell finds the response in
the same cell, and a second one over each cell's last response (one row for a URL and cell) finds it in
earlier cells. Payloads are never shuffled: a resolved revisit carries the response's record id and
payload digest.

Outcomes: ``resolved``; ``changed`` (the ETags, or without both of these the Last-Modified values,
differ); ``unvalidated`` (nothing on both sides to compare); ``no_response`` (none is earlier).

``parse_warc`` unpacks a file member by member and holds one record at a time; what cannot be read (a
file cut off, a length that is no number, a record of over ``MAX_RECORD`` bytes, a damaged member) is a
row of its own with its ``error``, and reading goes on at the next record where there is one. A damaged
member is one error; a record whose length was met before the damage is given with it, and the next
member is looked for in the packed bytes by how one begins.

Defined results: only responses with status 200 are full; of responses at the same time the greater
record id is the later; a response at the revisit's own time is not earlier; a record without a date
or URL is never a match, and a revisit without one has ``no_response``; header names are compared
without case, and of repeated ones the last counts; a default port is dropped for its own scheme only;
repeated rows each get a result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import durable

#: Rows of a cell, about.
CELL_ROWS = 16_384
#: A record of more bytes is given as an error.
MAX_RECORD = 1 << 30
#: Files are unpacked in steps of so many bytes.
STEP = 1 << 20
#: Headers that a not-modified answer may replace.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change a page.
TRACKING = r"utm_[a-z]+|gclid|fbclid"

RECORD = "record_id string, type string, target_uri string, date timestamp, status int, headers map<string,string>, payload binary, payload_digest string, refers_to string, error string"


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` or a default port, path without a last slash, other parameters sorted; no scheme or fragment."""
    url = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"(?s)^[^:/?]*://([^/?]*)", 1))
    port = F.when(F.regexp_like(bare, F.lit(r"^(?i:https)://")), ":443").when(F.regexp_like(bare, F.lit(r"^(?i:http)://")), ":80").otherwise("")
    host = F.when((port != "") & F.endswith(host, port), F.left(host, F.length(host) - F.length(port))).otherwise(host)
    host = F.regexp_replace(host, r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^:/?]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)["value"]))


def _validates(one: Column, other: Column) -> Column:
    """The outcome for the headers of a revisit and of a response."""
    tag = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), r"^W/", "")
    since = lambda h: F.try_element_at(h, F.lit("last-modified"))
    same = F.when(tag(one).isNotNull() & tag(other).isNotNull(), tag(one) == tag(other)).otherwise(since(one) == since(other))
    return F.when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("changed")


def _merged(response: Column, revisit: Column) -> Column:
    newer = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.coalesce(F.map_contains_key(newer, k), F.lit(False))), newer)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url, date, outcome, response_id, response_date, payload_digest and headers of every revisit.

    ``records``: record_id, type, target_uri, date, status, headers, payload_digest.
    """
    is_full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("date").isNotNull() & (F.col("url") != "")
    events = (
        records.filter(F.col("type").isin("response", "revisit"))
        .select("record_id", "type", "date", "status", _lower_keys(F.col("headers")).alias("headers"), "payload_digest", canonical_url(F.col("target_uri")).alias("url"))
        .withColumn("full", F.when(is_full, F.struct("date", "record_id", "payload_digest", "headers")))
        .filter((F.col("type") == "revisit") | F.col("full").isNotNull())
        .select("record_id", "type", "url", "date", "headers", "full", F.monotonically_increasing_id().alias("row"))
    )
    read = durable(events)
    able = F.col("date").isNotNull() & (F.col("url") != "")
    # Revisits stand before responses of the same time, which are not earlier.
    order = ["url", "date", F.col("full").isNotNull(), "record_id", "row"]
    cells_wanted = max(1, -(-read.count() // CELL_ROWS))
    events = durable(read.filter(able).repartitionByRange(cells_wanted, *order).withColumn("span", F.spark_partition_id()))
    running = Window.partitionBy("url", "span").orderBy("date", F.col("full").isNotNull(), "record_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumn("near", F.last("full", ignorenulls=True).over(running)).filter(F.col("type") == "revisit")
    last = events.filter("full IS NOT NULL").groupBy("url", "span").agg(F.max_by("full", F.struct("date", "record_id", "row")).alias("last"))
    asked = inside.filter("near IS NULL").select("url", "span").distinct()
    cells = last.unionByName(asked.select("url", "span", F.lit(None).cast(last.schema["last"].dataType).alias("last")))
    cells = cells.groupBy("url", "span").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).filter("far IS NOT NULL").select(F.col("url").alias("u"), F.col("span").alias("s"), "far")
    here = inside.filter("near IS NOT NULL").select("record_id", "url", "date", "headers", F.col("near").alias("hit"))
    before = inside.filter("near IS NULL").join(carried, (F.col("url") == F.col("u")) & (F.col("span") == F.col("s")), "left").select("record_id", "url", "date", "headers", F.col("far").alias("hit"))
    never = read.filter(~F.coalesce(able, F.lit(False)) & (F.col("type") == "revisit")).select("record_id", "url", "date", "headers", F.lit(None).cast(last.schema["last"].dataType).alias("hit"))
    joined = here.unionByName(before).unionByName(never)
    outcome = F.when(F.col("hit").isNull(), "no_response").otherwise(_validates(F.col("headers"), F.col("hit.headers")))
    resolved = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "date",
        "outcome",
        F.col("hit.record_id").alias("response_id"),
        F.col("hit.date").alias("response_date"),
        F.when(resolved, F.col("hit.payload_digest")).alias("payload_digest"),
        F.when(resolved, _merged(F.col("hit.headers"), F.col("headers"))).alias("headers"),
    )


# -- files ------------------------------------------------------------------------------------------


def _parse_headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return first, out


@dataclass
class Damage:
    """What stands between the bytes of a file where a compressed member is damaged."""

    error: str
    gave: bool
    """Whether the member gave any bytes before."""


MAGIC = b"\x1f\x8b\x08"


def _member_head(content: memoryview, at: int) -> int:
    """Where a gzip member's data begin; raises ValueError if none begins at ``at``."""
    if content[at : at + 3] != MAGIC or len(content) < at + 10:
        raise ValueError("no compressed member begins here")
    flags, data = content[at + 3], at + 10
    if flags & 4:
        data += 2 + int.from_bytes(content[data : data + 2], "little")
    for flag in (8, 16):  # a name and a comment, each ended by a zero
        if flags & flag:
            while data < len(content) and content[data]:
                data += 1
            data += 1
    return data + 2 * bool(flags & 2)


def _next_member(packed: bytes, at: int) -> int:
    """The next place at which a member begins that holds a record; the file's length if there is none."""
    while (at := packed.find(MAGIC, at)) >= 0:
        try:
            start = _member_head(memoryview(packed), at)
            if zlib.decompressobj(-15).decompress(packed[start : start + 4096], 5) == b"WARC/":
                return at
        except (ValueError, zlib.error):
            pass
        at += 1
    return len(packed)


def _salvaged(member, part: bytes) -> Iterator[bytes]:
    """What a damaged part gives up to the damage."""
    try:
        for k in range(len(part)):
            yield member.decompress(part[k : k + 1])
    except zlib.error:
        return


def _unpacked(content: bytes) -> Iterator[bytes | Damage]:
    """The bytes of a file, gzipped by record, as a whole, or not at all, in steps of bounded size.

    Where a member is damaged, what it gave is followed by a ``Damage``, and the next whole member goes on.
    """
    if content[:2] != MAGIC[:2]:
        for at in range(0, len(content), STEP):
            yield content[at : at + STEP]
        return
    view, begin = memoryview(content), 0
    while begin < len(content):
        check, size = 0, 0
        try:
            at = _member_head(view, begin)
            member = zlib.decompressobj(-15)
            while not member.eof:
                part, before = bytes(view[at : at + max(1, STEP // 4)]), member.copy()
                at += len(part)
                try:
                    out = member.decompress(part, STEP)
                    if not (part or out or member.eof):
                        raise EOFError("the file is cut off inside of a compressed member")
                    while out or member.unconsumed_tail:
                        check, size = zlib.crc32(out, check), size + len(out)
                        yield out
                        part, before = member.unconsumed_tail, member.copy() if member.unconsumed_tail else before
                        out = member.decompress(part, STEP) if part else b""
                except zlib.error:
                    for out in _salvaged(before, part):
                        size += len(out)
                        yield out
                    raise
            at -= len(member.unused_data)
            if view[at : at + 8] != check.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
                raise ValueError("a compressed member does not have its checksum")
            begin = at + 8
            while begin < len(content) and content[begin] == 0:  # padding between members
                begin += 1
        except (ValueError, EOFError, zlib.error) as e:
            yield Damage(f"{type(e).__name__}: {e}", size > 0)
            begin = _next_member(content, begin + 1)


class _Reader:
    """Bytes of a file taken as they are asked for, up to the next damage."""

    def __init__(self, content: bytes):
        self.parts, self.held, self.fault, self.own = _unpacked(content), bytearray(), None, False

    def more(self) -> bool:
        part = next(self.parts, None) if self.fault is None else None
        if isinstance(part, Damage):
            self.fault, self.own = part.error, part.gave
        elif part is not None:
            self.held += part
            return True
        return False

    def resume(self) -> bool:
        """Goes on after a damage; False at the file's end."""
        self.held.clear()
        damaged, self.fault = self.fault is not None, None
        return damaged

    def find(self, mark: bytes, most: int) -> int:
        """Where ``mark`` begins, reading on as needed; -1 if it doesn't within ``most`` bytes."""
        at = 0
        while True:
            found = self.held.find(mark, at)
            if found >= 0 or len(self.held) > most:
                return found
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes; None, and all that is left dropped, if there are fewer."""
        while len(self.held) < n:
            if not self.more():
                self.held.clear()
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> bool:
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more():
                return False
        del self.held[:n]
        return True


#: A record's own headers end within so many bytes.
MAX_HEAD = 1 << 20


def _failed(why: str, head: dict[str, str] | None = None) -> dict:
    head = head or {}
    return {
        "record_id": head.get("warc-record-id", "").strip("<>") or None, "type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
        "date": head.get("warc-date"), "status": None, "headers": {}, "payload": None, "payload_digest": None, "refers_to": None, "error": why,
    }


def parse_warc(content: bytes) -> Iterator[dict]:
    """The records of a WARC file; what cannot be read is a record with ``error``, and nothing is raised."""
    source, told = _Reader(content), False  # told: what is passed over now has been given as an error
    while True:
        start = source.find(b"WARC/", MAX_HEAD)
        if start < 0:
            if len(source.held) > MAX_HEAD:  # no record begins here: on to where one may
                del source.held[: len(source.held) - 5]
                continue
            if source.fault or (bytes(source.held).strip(b"\r\n\0 ") and not told):
                yield _failed(source.fault or "what follows the last record is none")
            if not source.resume():
                return
            told = False
            continue
        del source.held[:start]
        told = False
        stop = source.find(b"\r\n\r\n", MAX_HEAD)
        if stop < 0:
            yield _failed(source.fault or "a record's headers have no end")
            if len(source.held) > MAX_HEAD:
                del source.held[:5]
                told = True
            elif not source.resume():
                return
            continue
        _, head = _parse_headers(source.take(stop + 4)[:-4])
        length = head.get("content-length", "0")
        if not (length.isascii() and length.isdigit()):
            yield _failed(f"Content-Length is no number: {length[:100]!r}", head)
            told = True
            continue
        if len(length.lstrip("0")) > len(str(MAX_RECORD)) or int(length.lstrip("0") or 0) > MAX_RECORD:
            yield _failed(f"the record has more than {MAX_RECORD} bytes: {length[:100]}", head)
            if len(length) > 18:  # no such record is there to be passed over
                told = True
            elif not source.skip(int(length)) and not source.resume():
                return
            continue
        body = source.take(int(length.lstrip("0") or 0))
        if body is None:
            yield _failed(source.fault or "the record is cut off", head)
            if not source.resume():
                return
            continue
        status, headers, payload = None, {}, body
        if body.startswith(b"HTTP/"):
            top, _, payload = body.partition(b"\r\n\r\n")
            line, headers = _parse_headers(top)
            code = line.split()[1] if len(line.split()) > 1 else ""
            status = int(code) if code.isascii() and code.isdigit() and len(code) <= 9 else None
        row = {
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "status": status,
            "headers": headers,
            "payload": payload,
            "payload_digest": head.get("warc-payload-digest"),
            "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
            "error": None,
        }
        if source.find(b"WARC/", MAX_HEAD) < 0 and source.fault and source.own and not bytes(source.held).strip(b"\r\n\0 "):
            row["error"] = source.fault  # it came whole, but its member is damaged
            yield row
            if not source.resume():
                return
            continue
        yield row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files at ``path``, read through Spark's own file access, one file to a row.

    A file's packed bytes are held by its task, so its size is bounded by ``spark.sql.sources.binaryFile.maxLength``
    and the worker's memory; unpacked, one record is held at a time. Rows with ``error`` tell what could not be read.
    """
    return records_of(spark.read.format("binaryFile").load(path))


def records_of(files: DataFrame) -> DataFrame:
    """All records of WARC files given as rows with their ``content``."""
    fields = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                group, size = [], 0
                for record in parse_warc(content.as_py() or b""):
                    group.append(record)
                    size += len(record["payload"] or b"")
                    if len(group) == 256 or size > 16 * STEP:
                        yield batch(group)
                        group, size = [], 0
                if group:
                    yield batch(group)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        columns = [[list(r[f].items()) if f == "headers" else r[f] for r in rows] for f in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)

    ship(files.sparkSession)
    parsed = files.select("content").mapInArrow(run, RECORD.replace("date timestamp", "date string"))
    return parsed.withColumn("date", F.try_to_timestamp("date")).select(*fields)


def format_warc(records: list[dict], compress: bool = True) -> bytes:
    """A WARC file of the records; each is a gzip member of its own if compressed."""
    out = io.BytesIO()
    for r in records:
        lines = [f"HTTP/1.1 {r['status']} -", *(f"{k}: {v}" for k, v in (r["headers"] or {}).items())] if r["status"] else []
        body = (("\r\n".join(lines) + "\r\n\r\n").encode() if lines else b"") + (r["payload"] or b"")
        head = [
            "WARC/1.0",
            f"WARC-Type: {r['type']}",
            f"WARC-Record-ID: <{r['record_id']}>",
            f"WARC-Date: {r['date'].strftime('%Y-%m-%dT%H:%M:%SZ')}" if r["date"] else "",
            f"WARC-Target-URI: {r['target_uri']}" if r["target_uri"] else "",
            f"WARC-Payload-Digest: {r['payload_digest']}" if r["payload_digest"] else "",
            f"WARC-Refers-To: <{r['refers_to']}>" if r["refers_to"] else "",
            f"Content-Length: {len(body)}",
        ]
        whole = ("\r\n".join(x for x in head if x) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
        out.write(gzip.compress(whole, mtime=0) if compress else whole)
    return out.getvalue()


def warc_files(records: DataFrame) -> DataFrame:
    """file_no and content: records (with the columns of ``RECORD``) as WARC files, one or more to a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, b in enumerate(batches):
            rows = [r | {"headers": dict(r["headers"] or [])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([format_warc(rows)], pa.binary())], ["file_no", "content"])

    ship(records.sparkSession)
    return records.select(*[f.split()[0] for f in RECORD.split(", ") if f != "error string"]).mapInArrow(run, "file_no int, content binary")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Records for a table of pages (page_id, url, html): of each page a response, and a revisit some hours or days later.

    The page's id decides what the revisit says: a changed ETag for every 7th, no validators for every
    5th, and a date before any response for every 11th.
    """
    p = F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256), 1, 16), F.lit('"'))
    first = F.lit(1_704_067_200) + p % 365 * 86_400 + p % 86_400
    later = F.when(p % 11 == 0, F.lit(1_700_000_000) + p % 86_400).otherwise(first + 3_600 + p % 30 * 86_400)
    row = lambda kind, at, status, headers: F.struct(
        F.concat(F.lit(f"urn:{kind}:"), p.cast("string")).alias("record_id"), F.lit(kind).alias("type"), F.timestamp_seconds(at).alias("date"), F.lit(status).alias("status"), headers.alias("headers")
    )
    answer = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("etag"), F.lit("Cache-Control"), F.lit("max-age=60"))
    unchanged = F.create_map(F.lit("ETag"), F.when(p % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("etag"))), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (p % 1000).cast("string")), F.lit("Server"), F.lit("edge"))
    unchanged = F.when(p % 5 == 0, F.map_filter(unchanged, lambda k, v: k != "ETag")).otherwise(unchanged)
    base = pages.select("page_id", F.col("url").alias("target_uri"), etag.alias("etag"), F.concat(F.lit("sha256:"), F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)).alias("payload_digest"))
    both = base.select("target_uri", "payload_digest", F.explode(F.array(row("response", first, 200, answer), row("revisit", later, 304, unchanged))).alias("r"))
    return both.select("r.record_id", "r.type", "target_uri", "r.date", "r.status", "r.headers", F.when(F.col("r.type") == "response", F.col("payload_digest")).alias("payload_digest"))
