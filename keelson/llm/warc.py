"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

The writer makes one archive (members compressed one by one) per task in a
shared folder. A response record holds an HTTP message whose body is framed in
chunks; a block above ``segment`` bytes is split into a first record and
continuation records (WARC-Segment-Number, -Origin-ID, and on the last one
WARC-Segment-Total-Length). Pages whose payload another page has already given
are revisit records that refer to it.

The reader takes byte ranges of the archives, parses their records, groups
segments by their origin's id, orders them by number, verifies numbering and
total length, and only then removes the chunk framing and checks the payload
digest. Whole records skip the grouping.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm import common

END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: A fixed date keeps repeated writes of a page equal.
DATE = "2020-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class BadArchive(ValueError):
    """A record or a group of segments that does not add up."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = 8192) -> bytes:
    """HTTP chunked framing, ended by the empty chunk."""
    parts = [b"%x\r\n%b\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The bytes under chunked framing; extensions of a chunk's size line are ignored, trailers too."""
    out, at = [], 0
    while True:
        line = data.find(END, at)
        if line < 0:
            raise BadArchive("a chunk size line does not end")
        size = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != END:
            raise BadArchive("a chunk is shorter than it says")
        out.append(data[at : at + size])
        at += size + 2


def record_id(place: str, number: int = 1) -> str:
    """The id of a record, by its page's place in the archives: rows with one page id get records of their own."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{place} segment {number}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + END + END) + z.flush()


def _clean(value: str | None) -> str:
    """A header value without line breaks."""
    return " ".join((value or "").split())


def records_of(place: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, segment: int) -> Iterator[bytes]:
    """The records of a page: a revisit, one response, or a response in segments."""
    common_headers = [("WARC-Target-URI", _clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page is None else str(page)), ("X-Payload-Bytes", str(len(payload)))]
    if refers_to is not None:
        extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _clean(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(place)), *common_headers, *extra], HTTP)
        return
    block = HTTP + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(place)), *common_headers, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", "1")], block[:segment])
    parts = range(segment, len(block), segment)
    for number, at in enumerate(parts, 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(place, number)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url))]
        more += [("WARC-Segment-Number", str(number)), ("WARC-Segment-Origin-ID", record_id(place))]
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[at : at + segment])


def digest_column(html: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a text's UTF-8 bytes."""
    bits = F.conv  # base 32 by groups of five hex digits: 20 bits are four digits of base 32
    hexed = F.sha1(F.encode(html, "UTF-8"))
    groups = [F.lpad(bits(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 0) -> DataFrame:
    """``pages`` with payload_digest, refers_to (the smallest id of equal payloads of at least ``least`` bytes, else null) and its url.

    Only digests that occur twice or more are joined back, and the group side
    is one row per digest; the planner splits a hot digest's rows.
    """
    rows = pages.withColumn("payload_digest", digest_column(F.col(html_col)))
    groups = rows.where(F.octet_length(html_col) >= least).groupBy("payload_digest").agg(F.min(id_col).alias("first"), F.min_by(url_col, id_col).alias("refers_url"), F.count("*").alias("c"))
    groups = groups.where("c > 1").drop("c")
    joined = rows.join(groups, "payload_digest", "left")
    big = F.octet_length(html_col) >= least
    return joined.withColumn("refers_to", F.when(big & (F.col("first") < F.col(id_col)), F.col("first"))).drop("first")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, by its URI; a bare path is local."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = 16384, span: int = 4 << 20, least: int = 0) -> DataFrame:
    """Write the archives; returns the written table of byte ranges (path, start, length, records), of about ``span`` bytes each.

    A task's archive has a name of its own for each attempt. The table is
    written when all tasks are done and names the archives of those that
    succeeded, so what a lost or repeated attempt leaves is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        ranges, at, start, count, nth = [], 0, 0, 0, 0
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                for page, url, html, *rest in zip(*batch.columns, strict=True):
                    nth += 1
                    payload = (html.as_py() or "").encode()
                    for data in records_of(f"{name} {nth}", page.as_py(), url.as_py(), payload, *(x.as_py() for x in rest), segment):
                        out.write(data)
                        at += len(data)
                        count += 1
                    if at - start >= span:
                        ranges.append((name, start, at - start, count))
                        start, count = at, 0
        if at > start:
            ranges.append((name, start, at - start, count))
        if ranges:
            yield pa.record_batch([pa.array(c) for c in zip(*ranges, strict=True)], names=["name", "start", "length", "records"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), common.text_or_empty(html_col).alias("html"))
    rows = with_originals(rows, "page", "url", "html", least).select("page", "url", "html", "payload_digest", "refers_to", "refers_url")
    return common.saved(rows.mapInArrow(run, "name string, start long, length long, records long"), "archives")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the gzip members of some bytes, one record each."""
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data)
        if not z.eof:
            raise BadArchive("a gzip member does not end")
        data = z.unused_data
        cut = raw.find(b"\r\n\r\n")
        first, *lines = raw[:cut].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise BadArchive("a record has no version line")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(headers["Content-Length"])
        block = raw[cut + 4 : cut + 4 + size]
        if len(block) != size or raw[cut + 4 + size :] != END + END:
            raise BadArchive("a block is not as long as it says")
        yield headers, block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _number(value: str | None) -> int | None:
    return int(value) if value else None


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, data) segments of one origin, in any order."""
    segments = sorted({s[0]: s for s in segments}.values(), key=lambda s: s[0])  # a repeated segment counts once
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise BadArchive("segments are missing")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise BadArchive(f"the segments hold {len(block)} bytes of {segments[-1][1]}")
    return block


_ROW = "origin string, number int, total long, page long, url string, digest string, type string, refers_to long, size long, block binary"


def read_records(archives: DataFrame, folder: str) -> DataFrame:
    """All records of the byte ranges as rows; ``number`` is null for records that are not segmented."""
    spark = archives.sparkSession
    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("size", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        for batch in batches:
            for name, start, length, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(length, start)
                rows, have, count = [], 0, 0
                for h, block in parse(data):
                    count += 1
                    origin = h.get("WARC-Segment-Origin-ID") or h["WARC-Record-ID"]
                    rows.append((origin, _number(h.get("WARC-Segment-Number")), _number(h.get("WARC-Segment-Total-Length")), _number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), (h.get("WARC-Payload-Digest") or "").removeprefix("sha1:"), h["WARC-Type"], _number(h.get("X-Refers-To-Page")), _number(h.get("X-Payload-Bytes")), block))
                    have += len(block)
                    if have > 8 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, have = [], 0
                if count != records:
                    raise BadArchive(f"{name} has {count} records at {start}, not {records}")
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    dealt = archives.select("name", "start", "length", "records").repartition(common.partitions(spark))
    return dealt.mapInArrow(run, _ROW)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of records to pages; segments of one origin are adjacent."""
    held, parts = None, []

    def done(row: dict, block: bytes) -> tuple:
        payload = payload_of(block)
        digest = base32_sha1(payload)
        if row["digest"] != digest or row["size"] != len(payload):
            raise BadArchive(f"the payload of {row['origin']} is not what its header says")
        return row["page"], row["url"], payload, len(payload), digest, "response", None

    def flush() -> list[tuple]:
        if not parts:
            return []
        if held is None:
            raise BadArchive("continuation without its first segment")
        return [done(held, reassemble(parts))]

    names = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    origin = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["type"] == "revisit":
                out.append((row["page"], row["url"], None, row["size"], row["digest"], "revisit", row["refers_to"]))
            elif row["number"] is None:
                out.append(done(row, row["block"]))
            else:
                if row["origin"] != origin:
                    out += flush()
                    origin, held, parts = row["origin"], None, []
                if row["number"] == 1:
                    held = row
                parts.append((row["number"], row["total"], row["block"]))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if out := flush():
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


_PAGE = "page long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Pages of the archives: page, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Only segmented records are dealt by origin; a group is one record's segments.
    """
    records = read_records(archives, folder)
    whole = records.where("number is null").mapInArrow(_verify, _PAGE)
    parts = records.where("number is not null").repartition(common.partitions(archives.sparkSession), "origin").sortWithinPartitions("origin", "number")
    return whole.union(parts.mapInArrow(_verify, _PAGE))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = 16384) -> DataFrame:
    """Write every row of ``pages`` to archives, read them back; one row per page with its payload's digest and record type.

    A null html is an empty payload, equal to other empty ones; a null url is
    an empty target. Of rows with one payload that with the smallest id is the
    response; rows that share this id too are all responses. Rows with a null
    id are responses. Other columns, of any name, are ignored; an empty table
    gives no archive and an empty result.
    """
    spark = pages.sparkSession
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, id_col, url_col, html_col, segment)
    read = read_archives(archives, folder)
    return read.select(F.col("page").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
