"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a seek table at its end:
a skippable frame with each frame's compressed and plain size, then the count of frames and a magic number.
An index maps each record to its bundle, frame, and offset within the frame's plain bytes, so one record costs
one seek and one frame.  Bundles are written by tasks through pyarrow's file systems, under a name that no other
attempt has, and count only if their index rows were committed; what a lost attempt leaves is never read.

Payloads of ``min_revisit`` bytes or more that repeat are written once, for the smallest page_id; others are
revisit records that refer to it and keep length and digest in their headers.

Cases: a null payload is empty.  A null url is an empty target.  Of repeated rows with the smallest page_id all
are responses.  Ids are percent-encoded in headers, so any text, the empty one too, comes back as it was.  A null page_id never is the smallest; a payload of such rows alone has responses only.  An empty
table gives no bundles and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, materialize, scratch

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
MIN_REVISIT = 100
#: Tasks of a read, at most; each reads its bundles one after the other.
MOST_TASKS = 20_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, bundle string, frame int, offset long, length long"


class BundleWriter:
    """Frames of records, then the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.held, self.size, self.frames, self.written = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        at = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        return at

    def _flush(self) -> None:
        plain = b"".join(self.held)
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)
        self.out.write(packed)
        self.written += len(packed)
        self.frames.append((len(packed), len(plain)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    def __init__(self, source):
        """source: a seekable binary file."""
        self.source = source
        end = source.seek(0, io.SEEK_END)
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end")
        source.seek(end - 9 - 8 * n)
        sizes = [struct.unpack("<II", source.read(8)) for _ in range(n)]
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of refers_to, whose HTTP header tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: "" if x is None else "=" + quote(str(x), safe="")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_of(head: dict[str, str], header: str = "WARC-Record-ID") -> str | None:
    """The page_id in a header; null for the name of none."""
    text = head[header][len("<urn:x-page:") : -1]
    return unquote(text[1:]) if text else None


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where it should")
    return headers, data[begin:end], end + 4


def prefix_of(digest: str):
    """The first 20 bits."""
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("int")


def decide(pages: DataFrame, page_id: str, payload: str, min_revisit: int = MIN_REVISIT, broadcast_rows: int = 200_000) -> DataFrame:
    """pages with _payload, _digest and _first: the page_id of the response with an equal payload, where payloads repeat."""
    p = pages.withColumn("_payload", F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")))
    p = p.withColumn("_digest", F.sha2("_payload", 256))
    keyed = p.select(F.col(page_id).alias("_page"), "_digest", F.length("_payload").alias("_n")).filter(F.col("_n") >= min_revisit)
    repeats = keyed.groupBy("_digest").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").select(F.col("_digest").alias("_d"), "_first")
    repeats = materialize(repeats, "repeats")
    n = repeats.count()
    if n <= broadcast_rows:
        return p.join(F.broadcast(repeats), F.col("_digest") == F.col("_d"), "left").drop("_d")
    # A bit for each prefix of a repeated digest: a table of bounded size, by which the other payloads stay where they are.
    marks = repeats.select(prefix_of("_d").alias("_at")).distinct()
    p = p.join(F.broadcast(marks), prefix_of("_digest") == F.col("_at"), "left")  # at most 2^20 rows
    alone = p.filter("_at IS NULL").drop("_at").withColumn("_first", F.lit(None).cast(pages.schema[page_id].dataType))
    return alone.unionByName(p.filter("_at IS NOT NULL").drop("_at").join(repeats, F.col("_digest") == F.col("_d"), "left").drop("_d"))


def write_bundles(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row; return the index, itself written: record_id, bundle, frame, offset, length."""
    d = decide(pages.select(F.col(page_id).alias("_page"), F.col(url).alias("_url"), F.col(payload).alias("_html")), "_page", "_html", min_revisit)
    d = d.select("_page", "_url", "_payload", "_digest", F.when(~F.col("_first").eqNullSafe(F.col("_page")), F.col("_first")).alias("_refers"))

    def run(batches):
        writer = name = fs = None
        for b in batches:
            rows = []
            for page, link, body, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                if writer is None:
                    fs, path = file_system(folder)
                    fs.create_dir(path, recursive=True)
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                record = make_record(page, link, body, digest, refers)
                frame, offset = writer.add(record)
                rows.append((None if page is None else str(page), f"{folder}/{name}", frame, offset, len(record)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["record_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()

    return materialize(d.mapInArrow(run, INDEX), "warc-index")


RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Each record of the bundles that the index names: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload).

    A task reads whole bundles, frame by frame.  Response payloads are checked against digest and length.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def records(bundle: str):
        fs, path = file_system(bundle)
        with fs.open_input_file(path) as f:
            reader = BundleReader(f)
            for i in range(len(reader.frames)):
                data, at = reader.frame(i), 0
                while at < len(data):
                    head, block, at = parse_record(data, at)
                    stop = block.index(b"\r\n\r\n") + 4
                    http = dict(x.split(": ", 1) for x in block[: stop - 4].decode().split("\r\n")[1:])
                    n, digest, refers = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
                    body = block[stop:]
                    if refers is None and (len(body) != n or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} in {bundle} is damaged")
                    yield page_of(head), n, digest, head["WARC-Type"], refers and page_of(head, "WARC-Refers-To"), head["WARC-Target-URI"], body if payloads else None

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for bundle in b.column(0).to_pylist():
                held, size = [], 0
                for r in records(bundle):
                    held.append(r)
                    size += len(r[6] or b"") + 256
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    bundles = index.select("bundle").distinct()
    # rows of a name each stand for megabytes: as many tasks as bundles, up to MOST_TASKS, whatever the names' bytes
    out = bundles.repartition(max(1, min(MOST_TASKS, bundles.count())), "bundle").mapInArrow(run, RECORD)
    return out if payloads else out.drop("payload")


def read_records(index: DataFrame) -> DataFrame:
    """record_id, frame_id (the record's own header), payload_bytes and payload_digest of each row of the index, each read by its frame and offset alone; a frame is unpacked once for the records asked of it."""

    def run(batches):
        for b in batches:
            out, opened = [], {}
            for name, bundle, frame, offset, length in zip(*(b.column(i).to_pylist() for i in range(5))):
                if opened.get("bundle") != bundle:
                    if opened:
                        opened["file"].close()
                    fs, path = file_system(bundle)
                    opened = {"bundle": bundle, "file": fs.open_input_file(path)}
                    opened["reader"] = BundleReader(opened["file"])
                if opened.get("frame") != frame:
                    opened["frame"], opened["plain"] = frame, opened["reader"].frame(frame)
                head, block, end = parse_record(opened["plain"][offset : offset + length])
                if end != length:
                    raise ValueError(f"the index of {name} is wrong")
                http = dict(x.split(": ", 1) for x in block[: block.index(b"\r\n\r\n")].decode().split("\r\n")[1:])
                out.append((name, page_of(head), int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")))
            if opened:
                opened["file"].close()
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["record_id", "frame_id", "payload_bytes", "payload_digest"])

    ordered = index.repartition(max(1, min(MOST_TASKS, index.select("bundle").distinct().count())), "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(run, "record_id string, frame_id string, payload_bytes long, payload_digest string")


def fetch(index: DataFrame, record_id: str) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record: one seek, one frame."""
    r = index.filter(F.col("record_id") == record_id).first()
    if r is None:
        raise KeyError(record_id)
    fs, path = file_system(r.bundle)
    with fs.open_input_file(path) as f:
        return parse_record(BundleReader(f).record(r.frame, r.offset, r.length))[:2]


def verify_index(index: DataFrame, one_in: int = 16) -> None:
    """Read about one record in so many by its frame and offset alone; an error if another record stands there."""
    some = index.filter(F.pmod(F.xxhash64("record_id"), F.lit(one_in)) == 0)
    if read_records(some).filter(~F.col("record_id").eqNullSafe(F.col("frame_id"))).take(1):
        raise ValueError("the index names a place where another record stands")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_bundles(pages, scratch(spark, "warc"))
    verify_index(index)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_bundles(index).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM r
"""
