"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Every record is a gzip member of its own. Members are gathered into archives by their bytes and written by Spark's text
sink, so archives land in any store that Spark writes to. The reader goes by each record's Content-Length, never by what
a payload holds, and keeps one record in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stage
from .graph import connected_components

END = "\r\n\r\n"
LEAST_BYTES = 1000  # smaller payloads are never revisits
FILE_BYTES = 16 << 20  # an archive is closed once its members reach this
MEMBER_BYTES = 8 << 20  # of a record in one gzip member; a larger record goes on in another
CONCURRENT = b"warc-concurrent-to"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INFO = b"software: tarnloom\r\nformat: WARC File Format 1.1\r\n"
RECORD = (
    "type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, "
    "payload_digest string, http_header string, http_length long, fields map<string,string>, payload binary, error string"
)
NAMES = tuple(x.split(" ")[0] for x in RECORD.split(", "))
KINDS = {"requests": ("request",), "captures": ("response", "revisit", "resource"), "metadata": ("metadata",)}
MAX_RECORDS = 1000  # records of a capture in its row; others are in a table beside it


def _urn(kind: str, column: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(kind), F.col(column)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column | str) -> Column:
    """A header line; nothing where the value is null. Line breaks in a value become spaces."""
    value = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: Column | str, record_id: Column, content_type: str, block: Column, *more: Column) -> Column:
    head = [_header("WARC-Type", kind), _header("WARC-Record-ID", record_id), _header("WARC-Date", DATE), *more]
    length = [_header("Content-Type", content_type), _header("Content-Length", F.octet_length(block))]
    return F.concat(F.lit("WARC/1.1\r\n"), *head, *length, F.lit("\r\n"), block, F.lit(END))


def plan_captures(pages: DataFrame, seed: int = 7) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, capture, record_id) of each page.

    capture is response or revisit. The record id of a response that others revisit follows from the digest; other ids
    follow from the seed and a row's place in the scan, so a rerun over the same files gives the same ones. Only digests
    that repeat are staged; html is not.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    large = rows.filter(F.col("payload_bytes") >= LEAST_BYTES)
    first = large.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    first = first.groupBy("payload_digest").agg(F.max(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    first = stage(first.select(F.col("payload_digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.n").alias("ties"), F.lit(True).alias("repeats")), "firsts")
    rows = rows.join(first, F.col("payload_digest") == F.col("d"), "left").drop("d")
    top = F.coalesce(F.col("repeats") & F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    out = rows.withColumn("canonical", top & (F.col("ties") == 1))
    if not first.filter("ties > 1").isEmpty():  # rows that share the largest id: the first by url is the response
        tied = top & (F.col("ties") > 1)
        place = F.row_number().over(Window.partitionBy("payload_digest").orderBy("url"))
        out = rows.filter(~tied).withColumn("canonical", top).union(rows.filter(tied).withColumn("canonical", place == 1))
    other = F.concat(F.lit("<urn:uuid:"), F.uuid(seed), F.lit(">"))
    kind = F.when(F.col("canonical") | F.col("repeats").isNull(), "response").otherwise("revisit")
    own = F.when(F.col("canonical"), _urn("payload", "payload_digest")).otherwise(other)
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("capture"), own.alias("record_id"))


def records(captures: DataFrame) -> DataFrame:
    """(value): the text of three records for each capture."""
    revisit, own = F.col("capture") == "revisit", F.col("record_id")
    uri, digest = _header("WARC-Target-URI", F.col("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END))
    refers = [_header("WARC-Profile", PROFILE), _header("WARC-Refers-To", _urn("payload", "payload_digest"))]
    capture = F.when(
        revisit, _record("revisit", own, "application/http;msgtype=response", http, uri, digest, *refers),
    ).otherwise(_record("response", own, "application/http;msgtype=response", F.concat(http, F.col("html")), uri, digest))
    with_capture = _header("WARC-Concurrent-To", own)
    request = _record("request", _urn("request", "record_id"), "application/http;msgtype=request", asked, uri, with_capture)
    page = _header("pageId", F.col("page_id"))
    metadata = _record("metadata", _urn("metadata", "record_id"), "application/warc-fields", page, uri, with_capture)
    return captures.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def members(raw: bytes) -> bytes:
    """A record as gzip, of a fixed time: one member, or one for each MEMBER_BYTES of it."""
    out = []
    for at in range(0, max(1, len(raw)), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(raw[at : at + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def info_record() -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000000>\r\nWARC-Date: {DATE}\r\n"
    return (head + f"Content-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n").encode() + INFO + END.encode()


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzip archives of all pages in the folder `path`, each with a warcinfo record first.

    An archive ends with the record that takes it to file_bytes, so only a single larger record makes a larger one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive() -> pa.RecordBatch:
            # The sink ends a row by a zero byte. That is the last byte of a member: its length, little-endian, is below 2^24.
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])

        head = members(info_record())
        held, size = [head], len(head)
        for batch in batches:
            for value in batch.column(0):
                held.append(members(value.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield archive()
                    held, size = [head], len(head)
        if len(held) > 1:
            yield archive()

    packed = records(plan_captures(pages)).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


class _Stream:
    """Bytes of an archive, decompressed as they are asked for; a broken gzip member is reported and passed over."""

    def __init__(self, raw: memoryview):
        self.raw, self.at, self.start, self.member = raw, 0, 0, None
        self.held, self.errors = bytearray(), []
        self.zipped = bytes(raw[:2]) == b"\x1f\x8b"

    def more(self) -> bool:
        """Read on; False at the end."""
        while self.at < len(self.raw):
            part = self.raw[self.at : self.at + (1 << 16)]
            if not self.zipped:
                self.at += len(part)
                self.held += part
                return True
            if self.member is None:
                if part[0] == 0:  # padding between members
                    self.at += 1
                    continue
                self.member, self.start = zlib.decompressobj(31), self.at
            try:
                out = self.member.decompress(part)
            except zlib.error as e:
                self.errors.append(f"gzip member at byte {self.start}: {e}")
                after = bytes(self.raw).find(b"\x1f\x8b\x08", self.start + 1)
                self.member, self.at = None, after if after >= 0 else len(self.raw)
                continue
            self.at += len(part) - len(self.member.unused_data)
            if self.member.eof:
                self.member = None
            if out:
                self.held += out
                return True
        if self.member is not None:
            self.errors.append(f"gzip member at byte {self.start}: truncated")
            self.member = None
        return False

    def holds(self, n: int) -> bool:
        while len(self.held) < n:
            if not self.more():
                return False
        return True

    def find(self, what: bytes, at: int = 0) -> int:
        while (found := self.held.find(what, at)) < 0:
            at = max(at, len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return found


def parse(raw: memoryview) -> Iterator[tuple[dict, bytes, str | None]]:
    """(header, block, error) of each record of one archive, plain or gzip (in members or as a whole).

    What is no record, has no length or ends too early is given as an error without header and block; reading goes on at the
    next line that begins a record. So is a broken gzip member.
    """
    s = _Stream(raw)
    while True:
        while s.holds(2) and s.held[:2] == b"\r\n":
            del s.held[:2]
        if not s.held:
            break
        head, size, error = {}, None, None
        end = s.find(b"\r\n\r\n") if s.holds(5) and s.held[:5] == b"WARC/" else -1
        if end < 0:
            error = "no WARC record"
        else:
            for line in bytes(s.held[:end]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                name, value = name.strip().lower(), value.strip().decode("utf-8", "replace")
                if name == CONCURRENT:  # the only one of ours that may be repeated
                    value = [*head.get(name, []), value]
                head[name] = value
            length = head.get(b"content-length", "")
            size = int(length) if length.isascii() and length.isdigit() else None
            if size is None:
                error = "no Content-Length"
            elif not s.holds(end + 4 + size):
                error = "truncated record"
        if error is None:
            yield head, bytes(s.held[end + 4 : end + 4 + size]), None
            del s.held[: end + 4 + size]
            continue
        yield {}, b"", error
        after = s.find(b"\nWARC/", 1)
        if after < 0:
            break
        del s.held[: after + 1]
    for error in s.errors:
        yield {}, b"", error


def _row(head: dict, block: bytes, error: str | None) -> tuple:
    kind, http, length, fields, payload = head.get(b"warc-type"), None, None, {}, None
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
        lengths = [x[15:].strip() for x in http.split("\r\n") if x.lower().startswith("content-length:")]
        length = next((int(x) for x in lengths if x.isascii() and x.isdigit() and len(x) < 19), None)
        payload = body if kind == "response" else None
    elif kind == "resource":
        payload = block
    elif kind in ("metadata", "warcinfo"):
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
    named = (b"warc-record-id", CONCURRENT, b"warc-target-uri", b"warc-date", b"warc-refers-to", b"warc-payload-digest")
    return (kind, *(head.get(x) for x in named), http, length, list(fields.items()), payload, error)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record (RECORD), in batches of a few MB.

    A response's payload is the block behind its HTTP header; requests, revisits and metadata have none. What can't be read
    is a row with nothing but its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], list(NAMES))

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block, error in parse(memoryview(content.as_buffer())):
                    rows.append(_row(head, block, error))
                    size += len(block) + 500
                    if size > 8_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def _captures_of(ids: DataFrame) -> DataFrame:
    """(uid, capture_id) of each record of ids (uid, vertex, is_capture, to): the captures that it belongs to, or its orphans' id.

    A capture belongs to itself. Another record belongs to the captures that it is concurrent to, or that are concurrent to
    it. One without any belongs where the records do that it reaches through others of its kind: to the least of their
    captures. Where nothing leads to a capture, the least id of what hangs together stands for one.
    """
    links = stage(ids.select("uid", "vertex", "is_capture", F.explode("to").alias("to")).filter("to is not null and to <> vertex"), "links")
    captures = ids.filter("is_capture").select(F.col("vertex").alias("capture_id")).distinct()
    named = links.filter("not is_capture").join(captures, F.col("to") == F.col("capture_id")).select("uid", "capture_id")
    naming = links.filter("is_capture").select(F.col("vertex").alias("capture_id"), "to")
    naming = ids.filter("not is_capture").select("uid", "vertex").join(naming, F.col("vertex") == F.col("to"))
    near = stage(named.union(naming.select("uid", "capture_id")).distinct(), "near")
    out = ids.filter("is_capture").select("uid", F.col("vertex").alias("capture_id")).union(near)
    loose = ids.filter("not is_capture").join(near, "uid", "left_anti").select("uid", "vertex", "to")
    if loose.isEmpty():
        return out

    loose = stage(loose, "loose")
    settled = ids.filter("not is_capture").join(near, "uid").groupBy("vertex").agg(F.min("capture_id").alias("capture_id"))
    settled = stage(settled, "settled")
    points = loose.select("vertex", F.explode("to").alias("other")).filter("other is not null")
    met = ids.join(settled.select("vertex"), "vertex", "left_semi").select(F.col("vertex").alias("other"), F.explode("to").alias("vertex"))
    points = points.union(met.join(loose.select("vertex").distinct(), "vertex", "left_semi").select("vertex", "other")).distinct()
    points = points.join(settled.select(F.col("vertex").alias("other"), "capture_id"), "other", "left")
    points = stage(points, "points")
    # Of several ids that a record names, all but the settled ones hang together through it.
    parts = connected_components(points.filter("capture_id is null").select(F.col("vertex").alias("a"), F.col("other").alias("b")))
    parts = stage(loose.select("vertex").distinct().join(parts, F.col("vertex") == F.col("id"), "left").select("vertex", F.coalesce("component", "vertex").alias("part")), "parts")
    reached = points.filter("capture_id is not null").join(parts, "vertex").groupBy("part").agg(F.min("capture_id").alias("reached"))
    parts = parts.join(reached, "part", "left").select("vertex", F.coalesce("reached", "part").alias("capture_id"))
    return out.union(loose.join(parts, "vertex").select("uid", "capture_id"))


def assemble(
    rows: DataFrame, keep: tuple[str, ...] = tuple(x for x in NAMES if x not in ("concurrent_to", "error")), most: int = MAX_RECORDS,
) -> tuple[DataFrame, DataFrame]:
    """One row for each capture: capture_id, n_records, and its requests, captures and metadata as arrays of nested records.

    Captures are responses, revisits and resources. A record belongs to the captures that it is concurrent to or that are
    concurrent to it, directly or through other records; a request of two captures is in both rows. Records that lead to no
    capture share a row without one. Repeated ids share a row. Records of other types, and rows without a type or without
    both ids, are left out. Arrays are in order of record id, and empty where there is nothing.

    The second table (capture_id, kind, record) holds what a capture has beyond its `most` first records, so that no record is
    dropped and no task gathers an unbounded group. Only the fields in `keep` (record_id first) are carried.
    """
    record = F.struct(*[F.map_entries(c).alias(c) if c == "fields" else F.col(c) for c in keep])
    kind = F.lit(None).cast("string")
    for name, kinds in KINDS.items():
        kind = F.when(F.col("type").isin(*kinds), name).otherwise(kind)
    to = F.coalesce("concurrent_to", F.array().cast("array<string>"))
    known = rows.select(F.monotonically_increasing_id().alias("uid"), F.coalesce("record_id", F.get(to, 0)).alias("vertex"), to.alias("to"), kind.alias("kind"), record.alias("record"))
    known = stage(known.filter("kind is not null and vertex is not null"), "known")
    ids = known.select("uid", "vertex", (F.col("kind") == "captures").alias("is_capture"), "to")
    own = known.select("uid", "kind", "record").join(_captures_of(ids), "uid")
    sizes = stage(own.groupBy("capture_id").agg(F.count("*").alias("n_records")), "sizes")
    large = sizes.filter(F.col("n_records") > most).select("capture_id")
    other = (F.col("kind") != "captures").cast("int").alias("other")  # captures stand first
    order = F.struct(other, F.col("record.record_id").alias("record_id"), "uid")
    last = F.lit(None).cast("struct<other:int,record_id:string,uid:bigint>")
    if large.isEmpty():
        own = own.withColumn("last", last)
    else:
        first = own.join(large, "capture_id", "left_semi").select("capture_id", order.alias("o"))
        place = F.row_number().over(Window.partitionBy("capture_id").orderBy("o"))  # each task passes on `most` rows a capture
        first = first.withColumn("place", place).filter(F.col("place") <= most).groupBy("capture_id").agg(F.max("o").alias("last"))
        own = stage(own.join(first, "capture_id", "left"), "own")
    inside = F.col("last").isNull() | (order <= F.col("last"))
    arrays = [F.sort_array(F.collect_list(F.when(F.col("kind") == n, F.col("record")))).alias(n) for n in KINDS]
    main = own.filter(inside).groupBy("capture_id").agg(*arrays).join(sizes, "capture_id")
    return main.select("capture_id", "n_records", *KINDS), own.filter(~inside).select("capture_id", "kind", "record")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from its archive.

    A revisit's WARC-Refers-To names a response by record id; refers_to is the page of that response. Null html is an empty
    payload. A null page_id stays null. Repeated rows make a capture each; an empty table makes no capture. Pages of any
    length are read and written whole. Other columns of pages are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    response = F.col("type") == "response"  # payloads are measured where they are read, so the assembly moves none
    rows = read_archives(spark, path).filter(F.col("type") != "warcinfo").withColumns({
        "payload_bytes": F.when(response, F.length("payload").cast("long")).otherwise(F.col("http_length")),
        "payload_sha1": F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")),
    })
    kept = ("record_id", "type", "refers_to", "fields", "payload_bytes", "payload_sha1")
    rows = stage(rows.select("concurrent_to", *kept), "records")
    got = assemble(rows, kept)[0].withColumn("c", F.get("captures", 0)).withColumn("m", F.get("metadata", 0))
    page = F.get(F.filter("m.fields", lambda e: e["key"] == "pageId"), 0)["value"].cast("long")
    got = got.select(page.alias("page_id"), F.col("c.payload_bytes").alias("payload_bytes"), F.col("c.payload_sha1").alias("payload_digest"), F.col("c.type").alias("record_type"), F.col("c.record_id").alias("_id"), F.col("c.refers_to").alias("_to"))
    got = stage(got, "captures")
    page_of = got.filter("record_type = 'response'").select(F.col("_id").alias("_first"), F.col("page_id").alias("refers_to"))
    revisits = got.filter("record_type = 'revisit'").join(page_of, F.col("_to") == F.col("_first"), "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    firsts = got.filter("record_type = 'response'").select(*out, F.lit(None).cast("long").alias("refers_to"))
    return firsts.union(revisits.select(*out, "refers_to"))
