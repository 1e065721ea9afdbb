"""WARC archives compressed with a Zstandard dictionary (operator 7).

Each archive begins with a skippable frame that holds a dictionary built from the archive's own records; every record
is one Zstandard frame compressed with it, so records can be read singly. Of pages with equal payloads (SHA-1) the one
with the largest page_id is a response; others are revisit records, which hold the HTTP head but no payload and refer
to it. Archives are rolled at a size bound, so a task holds one at a time.

Archives are kept as rows of a table in the shared folder (name, bytes), which any file system that Spark writes can
hold; each row's bytes are a complete .warc.zst file.

Defined cases: null html is an empty payload, and empty payloads are equal payloads like others; of repeated rows
with the largest page_id each is a response, and equal rows, being one capture, have equal record ids; a null page_id is smaller than any other, and where all ids of a payload
are null each row is a response; an empty table gives no archive and no rows; further columns are ignored. A payload
larger than the bound makes an archive of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import as_batch, bounded_batches, pieces, stored

#: Bytes of records in an archive, about; records and bytes the dictionary is built from, and its size.
ROLL, SAMPLES, SAMPLE_BYTES, DICTIONARY = 8 << 20, 128, 4096, 16 << 10
MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
COLUMNS = ("page_id", "url", "html", "sha1", "keep", "keep_url")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    name = hashlib.sha1(f"{page_id} {digest} {kind}".encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One uncompressed WARC record. Null ids and addresses leave their header out. A revisit names the response's
    record, address and date."""
    n = len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {' '.join(refers_url.split())}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A complete file: skippable frame with the dictionary, then a frame for each record."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    try:
        raw = zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short records: their text itself is the dictionary
        raw = b"".join(samples)[:DICTIONARY]
    made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *(made.compress(r) for r in records)])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file, by its own dictionary."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at = 8 + size
    while at < len(data):
        one = reader.decompressobj()
        parts = [one.decompress(data[at : at + (1 << 16)])]
        fed = min(len(data), at + (1 << 16))
        while not one.eof:
            if fed == len(data):
                raise ValueError("a record without an end")
            parts.append(one.decompress(data[fed : fed + (1 << 20)]))
            fed = min(len(data), fed + (1 << 20))
        at = fed - len(one.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        if not head.startswith(VERSION):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in head[len(VERSION) :].decode().split("\r\n"))
        yield fields, rest[: int(fields["Content-Length"])]


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, sha1`` with ``keep``, the page that holds the payload's response.

    Only digests are aggregated (with a partial maximum before the shuffle). The join back is an equality join, whose
    hot keys adaptive execution splits.
    """
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    each = each.withColumn("sha1", F.sha1("html"))
    keep = each.groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("best")).select("sha1", F.col("best.page_id").alias("keep"), F.col("best.url").alias("keep_url"))
    return each.join(keep, "sha1")


def write(pages: DataFrame, roll: int = ROLL) -> DataFrame:
    """``archive`` (name) and ``content`` (a complete file) rows that hold a record for each page."""
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return as_batch({"archive": [f"part-{part:06d}-{n:06d}.warc.zst"], "content": [archive(held)]}, schema)

        for b in batches:
            for p in pieces(b, column="html"):
                for page, url, html, sha1, keep, keep_url in zip(*(p.column(c).to_pylist() for c in COLUMNS), strict=True):
                    own = page == keep
                    held.append(record(page, url, html.encode(), base32(sha1), "response" if own else "revisit", None if own else keep, keep_url))
                    size += len(held[-1])
                    if size >= roll:
                        yield out()
                        n, held, size = n + 1, [], 0
        if held:
            yield out()

    return stored(planned(pages).select(*COLUMNS).mapInArrow(run, "archive string, content binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """One row for each record. A response's digest and size are worked out from its payload."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows = []
                for f, block in records(data.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    size, digest = int(head.rpartition(b"Content-Length: ")[2]), f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response":
                        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != digest:
                            raise ValueError("a payload that differs from its digest")
                    rows.append((number("X-Page-ID"), size, digest, f["WARC-Type"], number("X-Refers-To-Page-ID")))
                if rows:
                    yield as_batch(dict(zip(names, zip(*rows, strict=True), strict=True)), schema)

    return archives.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
