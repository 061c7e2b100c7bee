"""WARC archives: a writer for pages, and a Spark data source that reads headers before payloads.

Records are gzip members, each with the 'sl' extra field of the WARC format's annex on compression:
its compressed and uncompressed length. The reader plans one partition a file, tells Spark which
predicates on record type and headers it applies itself, inflates only the head of each member, and
jumps over members that no predicate lets pass. Members without that field, and archives that are
not compressed, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from . import store
from .common import cut, scratch

DATE = "1970-01-01T00:00:00Z"
HEAD = 4096
#: Bytes of records that a writer gathers for one file.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def base32_sha1(binary: Column) -> Column:
    """The bare upper-case base32 SHA-1, by built-in functions: 40 bits are 8 digits."""
    hexed = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_urn(page_id: int | None) -> str:
    return f"<urn:page-id:{'' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has the headers of its payload and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that tells its own lengths."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _members(data: memoryview) -> Iterator[tuple[int, int, int | None]]:
    """(start, start of the deflated part, end or None if only inflating tells)."""
    at = 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {at}")
        flags, body, end = data[at + 3], at + 10, None
        if flags & 4:
            (n,) = struct.unpack_from("<H", data, body)
            x, stop = body + 2, body + 2 + n
            while x + 4 <= stop:
                (ln,) = struct.unpack_from("<H", data, x + 2)
                if data[x : x + 2] == b"sl" and ln == 8:
                    end = at + struct.unpack_from("<I", data, x + 4)[0]
                x += 4 + ln
            body = stop
        for bit in (8, 16):
            if flags & bit:
                while data[body]:
                    body += 1
                body += 1
        if flags & 2:
            body += 2
        if end is None:
            z = zlib.decompressobj(-15)
            x = body
            while not z.eof and x < len(data):
                z.decompress(data[x : x + 65536])
                x += 65536
            end = min(x, len(data)) - len(z.unused_data) + 8
        yield at, body, end
        at = end


def parse(head: bytes) -> tuple[dict[str, str], int] | None:
    """Headers, with lower-case names, and where they end; None if the head is too short."""
    stop = head.find(b"\r\n\r\n")
    if stop < 0:
        return None
    out: dict[str, str] = {}
    for line in head[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out, stop + 4


def _row(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": h.get("warc-refers-to"),
    }


def _http(block: bytes) -> tuple[int, int | None]:
    """Where the payload of an HTTP block starts, and the length that its headers tell."""
    if not block.startswith(b"HTTP/"):
        return 0, None
    got = parse(block)
    if got is None:
        return len(block), None
    told = got[0].get("content-length", "")
    return got[1], int(told) if told.isdigit() else None


def records(data: memoryview, keep, payload: bool, stats: dict | None = None) -> Iterator[dict]:
    """The records that keep(row) lets pass. stats counts the bytes inflated or copied."""
    stats = stats if stats is not None else {}
    gz = data[:2] == b"\x1f\x8b"

    def plain():
        at = 0
        while at < len(data):
            got, n = None, HEAD
            while got is None:
                got, n = parse(bytes(data[at : at + n])), n * 4
                if got is None and at + n // 4 >= len(data):
                    raise ValueError(f"no record at {at}")
            size = int(got[0].get("content-length", 0))
            begin = at + got[1]
            yield got[0], bytes(data[begin : begin + min(size, HEAD)]), size, lambda b=begin, s=size: bytes(data[b : b + s])
            at = begin + size + 4

    def packed():
        for _, body, end in _members(data):
            z, n, head = zlib.decompressobj(-15), HEAD, b""
            feed = bytes(data[body : min(end - 8, body + HEAD)])
            got = None
            while got is None:
                head += z.decompress(feed, HEAD)
                got = parse(head)
                if got is None:
                    feed = z.unconsumed_tail or bytes(data[body + n : min(end - 8, body + 2 * n)])
                    n += 0 if z.unconsumed_tail else n
                    if not feed:
                        raise ValueError(f"no record in the member at {body}")
            stats["bytes"] = stats.get("bytes", 0) + len(head)

            def whole(b=body, e=end, skip=got[1], size=int(got[0].get("content-length", 0))):
                block = zlib.decompress(data[b : e - 8], -15)
                stats["bytes"] += len(block)
                return block[skip : skip + size]

            yield got[0], head[got[1] :], int(got[0].get("content-length", 0)), whole

    for h, head, size, whole in packed() if gz else plain():
        row = _row(h)
        if not keep(row):
            continue
        start, told = _http(head[:size])
        if told is None and row["record_type"] != "revisit":
            told = size - start
        row |= {"headers": list(h.items()), "payload_length": told, "payload": None}
        if payload and row["record_type"] != "revisit":
            block = whole()
            if start >= len(head) and block.startswith(b"HTTP/"):
                start = _http(block)[0]
            row["payload"] = block[start:]
        yield row


class _File(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)


class WarcReader(DataSourceReader):
    """Partitions are files; predicates on the header columns are applied before payloads."""

    COLUMNS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")

    def __init__(self, options):
        self.path = options.get("path")
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.filters.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def keeps(self, row: dict) -> bool:
        for name, kind, value in self.filters:
            x = row[name]
            if x is None or kind == "EqualTo" and x != value or kind == "In" and x not in value or kind == "StringStartsWith" and not x.startswith(value):
                return False
        return True

    def partitions(self):
        return [_File(u) for u in store.files(self.path, (".warc", ".warc.gz"))] or [_File("")]

    def read(self, partition):
        if not partition.value:
            return
        rows, size = [], 0
        for r in records(store.get(partition.value), self.keeps, self.payload):
            rows.append(r)
            size += len(r["payload"] or b"") + 512
            if size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)"""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def _writer(folder: str):
    schema = pa.schema([("uri", pa.string()), ("records", pa.int64())])

    def run(batches):
        parts, size, n, part, done = [], 0, 0, 0, []

        def close():
            uri = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz"
            store.put(uri, parts)
            done.append((uri, n))

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(member(record(page_id, url, html, digest, refers)))
                size, n = size + len(parts[-1]), n + 1
                if size >= FILE_BYTES:
                    close()
                    parts, size, n, part = [], 0, 0, part + 1
        if n:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], schema=schema)

    return run


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """A record for each page (page_id, url, html); gives (uri, records).

    Of pages with equal payloads of min_bytes or more, that with the largest page_id is a response
    and the others revisit it; pages that share that id as well are all responses. Shorter payloads
    are all responses. A null html is an empty payload; a page without id is a response only if
    no page with an id has its payload. Equal payloads meet as one row a digest, and that table has
    only digests seen twice, so a page of which a third of the table are copies moves no payload
    twice.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    base = base.withColumn("digest", base32_sha1(F.col("html")))
    winners = base.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    winners = cut(winners.select("digest", "first"), "warc-winners")
    linked = base.join(winners, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return cut(linked.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_writer(folder), "uri string, records long"), "warc-files")


def _digests(batches):
    """Of payloads as they are read: bytes and digest."""
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64())])
    for batch in batches:
        kind, rid, told, refers, length, payload = (c.to_pylist() for c in batch.columns)
        digest = [d if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p, d in zip(payload, told)]
        size = [n if p is None else len(p) for p, n in zip(payload, length)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((kind, rid, digest, refers, size), schema)], schema=schema)


def read_pages(spark, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Digests and lengths of responses are computed from the payloads as read; a revisit has no
    payload, so its own are those that its headers tell.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    read = wanted.select("record_type", "record_id", "payload_digest", "refers_to", "payload_length", "payload").mapInArrow(_digests, "record_type string, record_id string, payload_digest string, refers_to string, payload_bytes long")
    number = lambda c: F.expr(f"try_cast(substring({c}, 14, length({c}) - 14) as long)")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    write_pages(pages, folder)
    return read_pages(pages.sparkSession, folder)
