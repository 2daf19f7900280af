"""WARC archives: writing, normalising monolithic gzip, and reading by offset index.

A monolithic archive is one gzip stream over all its records, so no record can be
reached alone.  The normaliser inflates the stream once, rewrites each record as a gzip
member of its own, and writes a sidecar index of offsets.  Archives are files on the
shared folder, opened through their URI; a task holds one record and one read buffer.
Files get their final name when they are complete, under a name of the attempt that
wrote them, and only names returned by finished tasks are read: a lost executor leaves
at most an unread file behind.

Results: null html is an empty payload; null ids and urls are left out of the record
and come back null; control characters in a url are percent-encoded; if several rows
have the smallest page_id of equal payloads, all of them are responses; repeated rows
are repeated records; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, functions as F

from chromatile.session import materialize, scratch_path

MIN_SHARED = 100
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: revisits point to the smallest page with their payload.

    Digests are counted before they meet the pages, and only shared ones do, in salted
    parts, so a payload that a third of the pages have crowds no task.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    shared = rows.filter(F.length("payload") >= min_shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    salted = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    # a null id is never the smallest of its payload; when all are null, none refers to another
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    return rows.withColumn("salt", salt).join(salted, ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.uri = f"{base}/{name}", f"{folder}/{name}"
        self.out, self.size = self.fs.open_output_stream(self.path + ".part", compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives of about ``archive_bytes`` of records; returns ``(archive, records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, n, size = [], None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                data = record(*(x.as_py() for x in row))
                if file is None:
                    file, packer, n, size = _File(folder, f"{uuid.uuid4().hex}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, GZIP), 0, 0
                file.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    file.write(packer.flush())
                    file.close()
                    done.append((file.uri, n))
                    file = None
        if file is not None:
            file.write(packer.flush())
            file.close()
            done.append((file.uri, n))
        names, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    return materialize(records.mapInArrow(run, "archive string, records long"), "archives")


def inflated(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The content of a gzip file of one member or many, read once."""
    unpack, fresh = zlib.decompressobj(GZIP), True
    while data := stream.read(size):
        while data:
            out = unpack.decompress(data, 4 * size)
            fresh = False
            yield out
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack, fresh = unpack.unused_data, zlib.decompressobj(GZIP), True
    if not fresh:
        raise ValueError("the gzip stream ends within a member")


def split_records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream."""
    held, need = bytearray(), 0
    for part in parts:
        held += part
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", bytes(held[:end]).lower())
                if not held.startswith(b"WARC/") or not length:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(length[1]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return headers | {"block": rest[: int(headers["content-length"])]}


INDEX = "archive string, offset long, length long, record_id string, record_type string, uri string, digest string"
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member per record and a ``.idx`` sidecar; returns the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                rows, name = [], uuid.uuid4().hex
                file, side = _File(folder, f"{name}.warc.gz"), _File(folder, f"{name}.warc.gz.idx")
                fs, path = FileSystem.from_uri(source)
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in split_records(inflated(stream)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = packer.compress(data) + packer.flush()
                        head = parse(data)
                        row = (file.uri, file.size, len(member), head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-payload-digest"))
                        rows.append(row)
                        side.write(json.dumps(dict(zip(INDEX_NAMES[1:], row[1:]))).encode() + b"\n")
                        file.write(member)
                        if len(rows) >= 5000:
                            yield _index_batch(rows)
                            rows = []
                file.close()
                side.close()
                yield _index_batch(rows)

    return materialize(archives.select("archive").mapInArrow(run, INDEX), "index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=INDEX_NAMES)


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_indexed(index: DataFrame) -> DataFrame:
    """Read single members by offset and check their payloads: one row per record."""
    number = lambda s: int(m[1]) if s and (m := re.search(r"urn:page:(-?\d+)>", s)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != opened:
                    if stream is not None:
                        stream.close()
                    fs, path = FileSystem.from_uri(archive)
                    stream, opened = fs.open_input_file(path), archive
                stream.seek(offset)
                head = parse(zlib.decompress(stream.read(length), GZIP))
                http, _, payload = head["block"].partition(b"\r\n\r\n")
                size = int(re.search(rb"content-length:[ \t]*(\d+)", http.lower())[1])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{archive}: the record at {offset} has another payload than it says")
                rows.append((number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[x.split()[0] for x in PAGES.split(", ")])
        if stream is not None:
            stream.close()

    return index.select("archive", "offset", "length").mapInArrow(run, PAGES)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives of the pages, normalise them, and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    written = write_archives(plan_records(pages), f"{folder}/raw", archive_bytes)
    index = normalise(written.repartition(max(1, written.count()), "archive"), f"{folder}/normal")
    return read_indexed(index)
