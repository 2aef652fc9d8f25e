"""WARC archives: one gzip member per record, written and read back in order.

Archives are files in the shared folder, a few thousand records each. A task writes
under a name of its own, and a table of the finished files says which ones count,
so that a task that is run again leaves a stray file and no double record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewake.llm.common import sized
from candlewake.session import fresh_path, stage

#: Payloads from this length on are stored once.
LEAST_REVISIT = 100
#: Uncompressed bytes after which the next archive begins.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:candlewake:page:"
SALTS = 16
#: Fixed, so that an archive is the same whenever it is written.
DATE = "2024-01-01T00:00:00Z"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a folder as Spark names it: a plain path, ``file:/path`` or a URI."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _uri(url: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the headers of its response without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def _members(file: BinaryIO) -> Iterator[bytearray]:
    """The inflated gzip members of a file, one after the other."""
    raw = b""
    while raw or (raw := file.read(READ_BYTES)):
        inflate, member = zlib.decompressobj(31), bytearray()
        while True:
            member += inflate.decompress(raw)
            if inflate.eof:
                break
            if not (raw := file.read(READ_BYTES)):
                raise ValueError("an archive ends inside a record")
        raw = inflate.unused_data
        yield member


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; a frame or a digest that does not hold is an error."""
    for member in _members(file):
        end = member.find(b"\r\n\r\n")
        lines = bytes(member[:end]).decode().split("\r\n")
        if end < 0 or lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        if len(member) != end + 4 + size + 4 or member[-4:] != b"\r\n\r\n":
            raise ValueError(f"{head.get('WARC-Record-ID')}: the length does not fit the record")
        block = bytes(member[end + 4 : end + 4 + size])
        if head["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError(f"{head.get('WARC-Record-ID')}: the block digest does not hold")
        yield head, block


def _page(text: str) -> int | None:
    number = text[1:-1].removeprefix(RECORD_ID)
    return int(number) if number else None


def parse(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    end = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[: end - 4].decode().split("\r\n")[1:])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block[end:] if kind == "response" else None
    if payload is not None and (
        len(payload) != int(http["Content-Length"]) or hashlib.sha256(payload).hexdigest() != digest
    ):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload digest does not hold")
    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers, payload


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: what each record holds.

    Null or missing html is an empty payload. Of equal payloads of ``LEAST_REVISIT``
    bytes or more, rows with the smallest key are responses (also when that key is
    repeated) and the others revisit it; a row without a key is a response.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.length("payload") >= LEAST_REVISIT)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1 and first is not null").select("digest", "first")
    first = sized(first, "warc-first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    other = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return (
        rows.withColumn("salt", salt)
        .join(first, ["digest", "salt"], "left")
        .select("page_id", "url", "payload", "digest", other.alias("refers_to"))
    )


def write(pages: DataFrame, **columns: str) -> DataFrame:
    """Write the archives; a table (path, records) of them, for ``read``."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _store(folder)
        where.create_dir(path, recursive=True)
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = where.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                out.write(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"]))
                size, n = size + len(row["payload"]), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return stage(planned(pages, **columns).mapInArrow(archives, "path string, records long"), "warc-files")


RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives, checked, in tasks of one archive or a few; with ``payloads`` also their bytes."""
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cells = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            for archive in batch.to_pylist():
                where, path = _store(archive["path"])
                rows, size, n = [], 0, 0
                with where.open_input_stream(path, compression=None) as file:
                    for head, block in read_records(file):
                        rows.append(parse(head, block)[: len(names)])
                        size, n = size + (len(block) if payloads else 200), n + 1
                        if size >= 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if n != archive["records"]:
                    raise ValueError(f"{path}: {n} records instead of {archive['records']}")
                if rows:
                    yield packed(rows)

    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(records, schema)

