"""WARC archives compressed with Zstandard: one frame for each record, and a dictionary in a
leading skippable frame.

Spark writes the archives itself: each record's frame is a row of a text file whose line ends are
empty skippable frames, which decoders pass over. So archives go to any file system that Spark
can write to, task by task, with its commit protocol, and a lost executor leaves no half archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_checked, released

#: Pages, and characters of each, that the compression dictionary is trained on; its size.
DICT_PAGES, DICT_CHARS, DICT_BYTES = 400, 1 << 15, 1 << 16
#: Payloads below this size are never replaced by a revisit.
REVISIT_BYTES = 100

# Magic numbers of the Zstandard and WARC formats.
_DICT_FRAME, _FRAME, _DICT, _SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0xEC30A437, 0x184D2A50
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame, as text.
_BETWEEN = struct.pack("<II", _SKIPPABLE, 0).decode("ascii")

RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 32 and ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """A compression dictionary from a bounded sample; no bytes where there is too little to learn."""
    order = F.xxhash64("page_id", "url")
    # About twice as many as needed, by their hash, so that only these are sorted and sent.
    share = max(1, pages.count() // (2 * DICT_PAGES))
    sample = pages.where("html is not null").where(F.pmod(order, F.lit(share)) == 0).orderBy(order, "page_id").limit(DICT_PAGES)
    texts = [r[0].encode("utf-8", "surrogatepass") for r in sample.select(F.substring("html", 1, DICT_CHARS)).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _frames(dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compress = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **given).compress
        stored = zstandard.ZstdCompressor(level=19).compress(dictionary)
        frames = [struct.pack("<II", _DICT_FRAME, len(stored)) + stored] if dictionary else []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256).to_pylist()
                frames += [compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["value"])
                frames = []

    return run


def write_archives(pages: DataFrame, path: str, dictionary: bytes, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages(page_id, url, html, ...) under path, an archive for each
    task. The payload is the html in UTF-8, of null nothing. Of the records with equal payloads of at
    least REVISIT_BYTES, those with the smallest page_id are responses and the others revisit it; rows
    that repeat this page_id are responses, too, and rows without a page_id revisit it like others."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    several = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = join_checked(rows, several.select("digest", "first"), "digest", "left", 120)
    rows = rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    frames = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(released(_frames(dictionary, date)), "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", _BETWEEN).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at this place ends, from the headers of its blocks."""
    at_block = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = bool(data[at + 4] & 4)
    while True:
        head = int.from_bytes(data[at_block : at_block + 3], "little")
        if at_block + 3 > len(data):
            raise ValueError("an archive ends within a frame")
        at_block += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            return at_block + 4 * checksum


def archive_records(data: bytes) -> Iterator[bytes]:
    """The decompressed records of one archive, one for each frame."""
    view, at = memoryview(data), 0
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic & 0xFFFFFFF0 == _SKIPPABLE:
            if magic == _DICT_FRAME and at == 0:
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", _FRAME):
                    content = decoder.decompress(content)
                if content[:4] != struct.pack("<I", _DICT):
                    raise ValueError("the leading frame holds no dictionary")
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
        elif magic == _FRAME:
            end = frame_end(view, at)
            if end > len(view):
                raise ValueError("an archive ends within a frame")
            expected = zstandard.frame_content_size(view[at : at + 18])
            out = decoder.decompress(view[at:end])
            if expected >= 0 and len(out) != expected:
                raise ValueError("a frame's size differs from its header")
            yield out
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def parse_record(raw: bytes) -> dict:
    """The fields of RECORD; raises ValueError where headers, lengths or digests are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(fields)
    if missing:
        raise ValueError(f"missing headers {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if not sep or length is None:
        raise ValueError("no HTTP header in a record")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload's length or digest differs from its header")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return {
        "page_id": int(page) if page is not None else None, "url": fields.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": int(refers) if refers is not None else None,
    }


def _read(payloads: bool):
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], types, strict=True)], names=list(rows[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for raw in archive_records(content.as_buffer().to_pybytes()):
                    rows.append(parse_record(raw) | ({} if payloads else {"payload": None}))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path, as in RECORD; payload is null for revisits, and for
    all with payloads=False. An archive is read whole by one task; write_archives makes them no larger
    than the compressed rows of one of its tasks. A damaged archive fails with what is wrong."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(released(_read(payloads)), RECORD)
